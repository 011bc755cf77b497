"""Secret scans by grammar inference.

Base secrets are found by three patterns.  They are the labelled credentials: of
each kind a bounded sample (``SAMPLE`` distinct values of at most ``LONGEST``
characters, the smallest by hash of all) goes to the driver.  There, characters are
first joined into classes where their frequencies agree (a hexadecimal format has
one class of sixteen).  A prefix tree of class symbols is built, and states that are
statistically compatible (their symbol and end frequencies differ by no more than a
Hoeffding bound, all the way down) are merged into a probabilistic automaton.  A
bounded sample of ordinary runs (plain words and plain numbers, also joined by
separators) gives the background: an automaton whose states are the last character.

Every candidate in every text, that is every run of credential characters from the
shortest length learnt, is scored by its log-likelihood under the best credential
automaton less that under the background.  One over ``THRESHOLD`` becomes a span of
kind ``grammar`` if it touches no base span.

Symbols are characters for the part that all samples of a kind begin with, and
character classes after it; a class shares its probability evenly among its members.

Defined results: a null text counts as empty; without base secrets there are no
automata and no ``grammar`` spans; without ordinary runs all characters are equally
likely in the background; texts and candidates of any length are read whole; a value
of more than ``LONGEST`` characters is found and scored, but not learnt from;
repeated rows are rows like any other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, materialize, scratch, slices, small_batches

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "grammar")

#: Values of a kind, and ordinary runs, that a model is trained on; the longest of them.
SAMPLE, LONGEST = 800, 512
ALPHA = 0.05
#: Log-likelihood ratio from which a candidate counts: the odds of one run in a million.
THRESHOLD = math.log(1e6)
#: Log-probability of what an automaton has never seen.
FLOOR = math.log(1e-4)
#: Verdicts on runs that a worker remembers.
MEMO_RUNS = 400_000
LETTERS = "A-Za-z0-9+/_.=-"
_PLAIN = r"(?:[a-z]{1,24}|[A-Z][a-z]{1,23}|[A-Z]{1,16}|[0-9]+)"
#: Plain words, of no more letters than words have, and plain numbers.
ORDINARY = re.compile(rf"{_PLAIN}(?:[+/_.=-]+{_PLAIN})*")


def runs_of(shortest: int) -> re.Pattern[str]:
    """Runs of credential characters; full stops at the end are not part of a candidate."""
    return re.compile(rf"[{LETTERS}]{{{shortest},}}")


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the base secrets; of an assignment, what is assigned."""
    low = text.lower()
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):  # else the pattern can't match
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    return sorted(x[:3] for x in base_matches(text))


def base_values(text: str) -> list[tuple[str, str]]:
    return [(KINDS[kind], value) for _, kind, _, value in base_matches(text)]


#: Characters whose frequencies are never told apart.
ATOMS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")


def character_classes(values: list[str]) -> dict[str, str]:
    """Which class each character belongs to: atoms are joined while their members are about equally frequent.

    Members that a well-filled atom never shows (as 0, 1, 8 and 9 in base 32) are a class of their own.
    """
    counts = Counter(c for v in values for c in v)
    classes = []
    for atom in ATOMS:
        n, seen = sum(counts[c] for c in atom), "".join(c for c in atom if counts[c])
        if n < 10 * len(atom):
            seen = atom
        classes += [(seen, n)] + [("".join(c for c in atom if c not in seen), 0)] * (seen != atom)
    classes.sort(key=lambda x: -x[1] / len(x[0]))
    joined: list[tuple[str, int]] = []
    for members, n in classes:
        if n and joined:
            others, m = joined[-1]
            share = (n + m) / (len(members) + len(others)) * len(members)
            # as many as the joint share says, up to three standard deviations and a quarter
            if abs(n - share) <= 3 * math.sqrt(share) + 0.25 * share:
                joined[-1] = (others + members, n + m)
                continue
        joined.append((members, n))
    return {c: members for members, _ in joined for c in members}


@dataclass
class Model:
    """A probabilistic automaton: for each state, symbol -> (log probability, next), and the log probability of an end."""

    prefix: str = ""
    classes: dict[str, str] = field(default_factory=dict)
    moves: list[dict[str, tuple[float, int]]] = field(default_factory=list)
    ends: list[float] = field(default_factory=list)

    def symbols(self, word: str) -> list[str]:
        n = len(self.prefix)
        if n and word.startswith(self.prefix):
            return [*(f"\0{c}" for c in self.prefix), *map(self.classes.__getitem__, word[n:])]
        return [self.classes[c] for c in word]

    def score(self, word: str) -> float:
        """Log-likelihood, the end included; unknown moves cost ``FLOOR`` and stay."""
        total, at = 0.0, 0
        for s in self.symbols(word):
            p, nxt = self.moves[at].get(s, (FLOOR, at))
            total, at = total + p - (0.0 if s[0] == "\0" else math.log(len(s))), nxt
        return total + max(self.ends[at], FLOOR)


@dataclass
class Background:
    """Ordinary runs: an automaton whose state is the last character."""

    moves: dict[str, float] = field(default_factory=dict)

    def score(self, word: str) -> float:
        if not self.moves:
            return -(len(word) + 1) * math.log(sum(map(len, ATOMS)))
        at = f"^{word}$"
        return sum(self.moves.get(at[k : k + 2], FLOOR) for k in range(len(at) - 1))

    @staticmethod
    def of(words: list[str]) -> Background:
        pairs = Counter(f"^{w}$"[k : k + 2] for w in words for k in range(len(w) + 1))
        firsts: Counter[str] = Counter()
        for pair, n in pairs.items():
            firsts[pair[0]] += n
        return Background({pair: max(math.log(n / firsts[pair[0]]), FLOOR) for pair, n in pairs.items()})


class Merger:
    """State merging over a prefix tree, red and blue states in breadth-first order."""

    def __init__(self, words: list[list[str]]):
        self.count, self.end, self.next, self.by = [0], [0], [{}], [{}]
        for word in words:
            at = 0
            self.count[0] += 1
            for s in word:
                if s not in self.next[at]:
                    self.next[at][s] = len(self.count)
                    self.count.append(0)
                    self.end.append(0)
                    self.next.append({})
                    self.by.append({})
                self.by[at][s] = self.by[at].get(s, 0) + 1
                at = self.next[at][s]
                self.count[at] += 1
            self.end[at] += 1

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not self.count[a] or not self.count[b]:
                continue
            if self.differ(self.end[a], self.count[a], self.end[b], self.count[b]):
                return False
            for s in self.by[a].keys() | self.by[b].keys():
                if self.differ(self.by[a].get(s, 0), self.count[a], self.by[b].get(s, 0), self.count[b]):
                    return False
                if s in self.next[a] and s in self.next[b] and self.next[a][s] != self.next[b][s]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Merge the tree below ``b`` into ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.end[a] += self.end[b]
            for s, n in self.by[b].items():
                self.by[a][s] = self.by[a].get(s, 0) + n
                if s in self.next[a]:
                    todo.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def run(self) -> Model:
        red = [0]
        while True:
            blue = [(r, s, t) for r in red for s, t in sorted(self.next[r].items()) if t not in red]
            if not blue:
                break
            r, s, t = blue[0]
            into = next((q for q in red if self.compatible(q, t)), None)
            if into is None:
                red.append(t)
            else:
                self.next[r][s] = into
                self.fold(into, t)
        number = {q: k for k, q in enumerate(red)}
        model = Model()
        for q in red:
            n = max(1, self.count[q])
            model.moves.append({s: (math.log(self.by[q][s] / n), number[t]) for s, t in self.next[q].items()})
            model.ends.append(math.log(max(self.end[q] / n, 1e-3)))
        return model


def learn(values: list[str]) -> Model:
    """An automaton of the values; their common beginning is kept letter by letter."""
    prefix = ""
    if len(values) > 1:
        low, high = min(values), max(values)
        while len(prefix) < min(len(low), len(high)) and low[len(prefix)] == high[len(prefix)]:
            prefix += low[len(prefix)]
    prefix = prefix if len(prefix) >= 3 else ""
    classes = character_classes([v[len(prefix) :] for v in values])
    draft = Model(prefix, classes)
    model = Merger([draft.symbols(v) for v in values]).run()
    model.prefix, model.classes = prefix, classes
    return model


@dataclass
class Grammar:
    kinds: dict[str, Model]
    background: Background
    shortest: int = 6
    memo: dict[str, bool] = field(default_factory=dict)

    def score(self, word: str) -> float:
        """Log-likelihood ratio of the best format against ordinary runs."""
        if not self.kinds:
            return -math.inf
        return max(m.score(word) for m in self.kinds.values()) - self.background.score(word)

    def accepts(self, word: str) -> bool:
        found = self.memo.get(word)
        if found is None:
            found = self.score(word) >= THRESHOLD
            if len(word) <= 64:
                if len(self.memo) >= MEMO_RUNS:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans, and those candidates over the threshold that touch none of them."""
        base = base_spans(text)
        if not self.kinds:
            return base
        runs = runs_of(self.shortest)
        wanted = {w for w in set(runs.findall(text)) if len(w.rstrip(".")) >= self.shortest and self.accepts(w.rstrip("."))}
        if not wanted:
            return base
        out, k = list(base), 0
        ends, furthest = [], 0
        for _, _, e in base:
            furthest = max(furthest, e)
            ends.append(furthest)
        for m in runs.finditer(text):
            if m[0] not in wanted:
                continue
            end = m.start() + len(m[0].rstrip("."))
            while k < len(base) and base[k][0] < end:
                k += 1
            if not k or ends[k - 1] <= m.start():
                out.append((m.start(), 3, end))
        return sorted(out)


def _digest(value: str) -> str:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Least:
    """Of each kind the distinct values with the smallest hashes."""

    def __init__(self, n: int):
        self.n = n
        self.held: dict[str, dict[str, str]] = {}
        self.limit: dict[str, str] = {}

    def add(self, kind: str, value: str, digest: str) -> None:
        held = self.held.setdefault(kind, {})
        if digest < self.limit.get(kind, "g"):
            held[digest] = value
            if len(held) >= 4 * self.n:
                self.cut(kind)

    def cut(self, kind: str) -> None:
        held = self.held[kind]
        keep = heapq.nsmallest(self.n, held)
        self.held[kind] = {d: held[d] for d in keep}
        if len(keep) == self.n:
            self.limit[kind] = keep[-1]

    def batch(self) -> pa.RecordBatch:
        for kind in list(self.held):
            self.cut(kind)
        rows = [(k, v, d) for k, held in self.held.items() for d, v in held.items()]
        return pa.RecordBatch.from_pydict({name: pa.array([r[c] for r in rows], pa.string()) for c, name in enumerate(("kind", "value", "hash"))})


_SAMPLED = "kind string, value string, hash string"


def labelled(docs: DataFrame, n: int) -> DataFrame:
    """kind, value, hash of base secrets and of ordinary runs: at most ``n`` of a kind from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, seen = Least(n), set()
        runs = runs_of(6)
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                for kind, value in base_values(text or ""):
                    if len(value) <= LONGEST:
                        least.add(kind, value, _digest(value))
                for word in {w.rstrip(".") for w in runs.findall(text or "")} - seen:
                    if len(seen) >= MEMO_RUNS:
                        seen.clear()
                    seen.add(word)
                    if len(word) <= LONGEST and ORDINARY.fullmatch(word):
                        least.add("ordinary", word, _digest(word))
        yield least.batch()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, _SAMPLED)


def fewer(sampled: DataFrame, n: int, tasks: int = 64) -> DataFrame:
    """The same of ``tasks`` parts by hash, so that what the driver sorts does not grow with the tasks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = Least(n)
        for part in batches:
            for kind, value, digest in zip(*(part.column(c).to_pylist() for c in ("kind", "value", "hash")), strict=True):
                least.add(kind, value, digest)
        yield least.batch()

    return sampled.repartition(tasks, "hash").mapInArrow(run, _SAMPLED)


def infer(docs: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Learn the automata from bounded samples of base secrets and of ordinary runs."""
    by_kind = {}
    with scratch(docs.sparkSession):
        found = materialize(fewer(labelled(docs, sample), sample), "secret-sample")
        for kind in (*KINDS[:3], "ordinary"):
            rows = found.where(F.col("kind") == kind).orderBy("hash").limit(sample).collect()  # at most ``sample`` rows
            by_kind[kind] = [r["value"] for r in rows]
    background = Background.of(by_kind.pop("ordinary"))
    learnt = {k: v for k, v in by_kind.items() if len(v) >= 5}
    return Grammar({k: learn(v) for k, v in learnt.items()}, background, min((len(w) for v in learnt.values() for w in v), default=6))


def scan_secrets(docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar."""
    grammar = grammar or infer(docs)

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [grammar.spans(t or "") for t in part.column("text").to_pylist()]
            count = lambda kind: pa.array([sum(s[1] == kind for s in spans) for spans in found], pa.int64())
            base = [joined([s for s in spans if s[1] < 3]) for spans in found]
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_assign": count(0),
                    "n_access": count(1),
                    "n_hex": count(2),
                    "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                    "spans": pa.array(list(map(joined, found)), pa.string()),
                    "n_grammar": count(3),
                }
            )

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_grammar bigint"
    return map_slices(docs.select("doc_id", "text"), make, schema)
