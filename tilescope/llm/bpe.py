"""Byte-level BPE by length-bucketed padded matrices.

The distinct pre-tokens of up to ``CHUNK_CHARS`` characters of text are grouped by
length into padded integer matrices.  In each round every row merges its leftmost pair of minimum
rank; ranks of pairs come from an open-addressing hash table over (left id,
right id); rows without a mergeable pair leave the matrix (compaction).

Rounds cost the square of a row's length, so pre-tokens over ``LONGEST_ROW``
bytes take the same rule through a heap of pairs; results are equal.

Defined results: a null text counts as empty; an empty text has no ids; special
tokens' strings are ordinary text; texts and pre-tokens of any length are whole; of
pairs of equal rank the leftmost merges first; repeated rows are encoded each; an
empty table gives an empty result; other columns, whatever their names, are not read by
``encode_decode`` and come through ``encode_documents`` as they were.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import BATCH_ROWS, map_slices, unused

#: The Unicode characters of White_Space, as the rank files' own tokenizer reads \s.
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONGEST_ROW = 256
NO_RANK = np.int32(2**31 - 1)
#: Characters that are encoded at a time.
CHUNK_CHARS = 1_500_000
#: The pattern that is matched by character classes instead of a regex engine.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def compile_pattern(pattern: str) -> regex.Pattern:
    """``\\s`` and ``\\S`` are spelled out: Python counts 0x1C to 0x1F as white space."""
    inside = regex.sub(r"\[\^\\s", lambda _: rf"[^{WHITE}", pattern)
    return regex.compile(inside.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PairTable:
    """Hash table with linear probing: (left id, right id) to the merged id, which is its rank."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NO_RANK, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self.slots(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == -1)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.ranks[at] = keys[todo[won]], ranks[todo[won]]
            rest = np.ones(len(todo), dtype=bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NO_RANK`` where there is none or one side is padding (-1)."""
        found = np.full(left.shape, NO_RANK, dtype=np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = (left.ravel()[at].astype(np.int64) << 32) | right.ravel()[at]
        slot, flat = self.slots(keys), found.ravel()
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            flat[at[hit]] = self.ranks[slot[hit]]
            more = ~hit & (there != -1)
            at, keys, slot = at[more], keys[more], (slot[more] + 1) & self.mask
        return flat.reshape(left.shape)


class Encoder:
    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.pattern = compile_pattern(pattern)
        self.known_pattern = pattern == GPT2_PATTERN
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, merged = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        self.pairs = PairTable(np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int32))
        self.ranks = ranks
        by_id = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            by_id[i] = b
        self.tokens = Gather(by_id)
        self.decimals = Gather([f"{i} ".encode() for i in range(len(by_id))])
        # whole pre-tokens that have a rank no chain of merges leads to
        self.unreached: dict[bytes, int] = {}
        ids, sizes = self.encode_unique(self.tokens.data, self.tokens.start, self.tokens.size)
        first = ids[np.minimum(sizes.cumsum() - sizes, len(ids) - 1)]
        for i in np.flatnonzero((sizes != 1) | (first != np.arange(len(sizes)))).tolist():
            if by_id[i]:
                self.unreached[by_id[i]] = i

    def encode_unique(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, one after the other, and how many each has."""
        done = [Found(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32))]
        width = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        for w in np.unique(width[size > 0]).tolist():
            members = np.flatnonzero((width == w) & (size > 0))
            if w > LONGEST_ROW:
                for k in members.tolist():
                    ids = np.array(self.by_heap(data[start[k] : start[k] + size[k]].tobytes()), dtype=np.int32)
                    done.append(Found(np.array([k]), np.array([len(ids)]), ids))
                continue
            step = max(1, 400_000 // w)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                inside = np.arange(w) < size[some][:, None]
                matrix = np.full(inside.shape, -1, dtype=np.int32)
                matrix[inside] = self.byte_ids[data[(start[some][:, None] + np.arange(w))[inside]]]
                done += self.by_matrix(matrix, some)
        owner = np.concatenate([x.owner for x in done])
        counts = np.concatenate([x.counts for x in done])
        order = np.argsort(np.repeat(owner, counts), kind="stable")
        sizes = np.zeros(len(size), dtype=np.int64)
        sizes[owner] = counts
        return np.concatenate([x.ids for x in done])[order], sizes

    def by_matrix(self, ids: np.ndarray, owner: np.ndarray) -> list[Found]:
        done = []
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(ids):
            row = np.arange(len(ids))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), dtype=np.int64)
            best = ranks[row, at] if ranks.shape[1] else np.full(len(ids), NO_RANK)
            ended = best == NO_RANK
            if ended.any():  # compaction
                stay = ids[ended]
                done.append(Found(owner[ended], (stay >= 0).sum(axis=1), stay[stay >= 0]))
                going = ~ended
                ids, ranks, owner, at, best = ids[going], ranks[going], owner[going], at[going], best[going]
                row = np.arange(len(ids))
                if not len(ids):
                    break
            ids[row, at] = best
            ids = _without(ids, at + 1)
            if ids.shape[1] == 1:
                ranks = np.empty((len(ids), 0), dtype=np.int32)
                continue
            # of the pairs, the merged one goes; its neighbours are looked up anew
            ranks = _without(ranks, np.minimum(at, ranks.shape[1] - 1))
            left = at > 0
            ranks[row[left], at[left] - 1] = self.pairs.find(ids[row[left], at[left] - 1], ids[row[left], at[left]])
            right = at < ranks.shape[1]
            ranks[row[right], at[right]] = self.pairs.find(ids[row[right], at[right]], ids[row[right], at[right] + 1])
        return done

    def by_heap(self, word: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        part = [bytes([b]) for b in word]
        heap = [(r, k) for k in range(n - 1) if (r := self.ranks.get(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or self.ranks.get(part[k] + part[j]) != r:
                continue  # a pair that is no more
            part[k], ids[k], alive[j] = part[k] + part[j], r, False
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (x := self.ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (x, a))
        return [i for i, ok in zip(ids, alive, strict=True) if ok]

    def encode_cut(self, cut: Cut) -> Gather:
        """Ids of the pre-tokens of ``cut``, by pre-token."""
        some, which = distinct(cut)
        ids, sizes = self.encode_unique(cut.data, cut.start[some], cut.size[some])
        if self.unreached:
            words = [cut.data[a : a + n].tobytes() for a, n in zip(cut.start[some].tolist(), cut.size[some].tolist(), strict=True)]
            parts = np.split(ids, sizes.cumsum()[:-1])
            parts = [np.array([self.unreached[w]], dtype=np.int32) if w in self.unreached else x for w, x in zip(words, parts, strict=True)]
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        found = Gather(ids, sizes)
        return Gather(found.take(which), sizes[which])

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        pending: list[str] = []
        owners: list[int] = []
        room = CHUNK_CHARS

        def flush() -> None:
            cut = self.cut(pending)
            ids = self.encode_cut(cut)
            ends = np.concatenate([[0], ids.size.cumsum()])[np.concatenate([[0], cut.counts.cumsum()])]
            for owner, a, b in zip(owners, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[owner].append(ids.data[a:b])
            pending.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for piece in chunks(text):
                if pending and len(piece) > room:
                    flush()
                    room = CHUNK_CHARS
                pending.append(piece)
                owners.append(k)
                room -= len(piece)
        if pending:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.empty(0, dtype=np.int32)]) for x in out]

    def cut(self, texts: list[str]) -> Cut:
        return cut_gpt2(texts) if self.known_pattern else cut_by(self.pattern, texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.take(ids).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return self.decimals.take(ids).tobytes()[:-1]


class Gather:
    """Strings (of bytes or of ids) end to end, taken by number."""

    def __init__(self, parts: list[bytes] | np.ndarray, size: np.ndarray | None = None):
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8) if size is None else parts
        self.size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) if size is None else size
        self.start = self.size.cumsum() - self.size

    def take(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        shift = np.repeat(self.start[at] - (size.cumsum() - size), size)
        return self.data[shift + np.arange(len(shift))]


class Cut(NamedTuple):
    """Pre-tokens of some texts: their bytes, and how many each text has."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    counts: np.ndarray


def chunks(text: str) -> list[str]:
    """A long text in pieces, cut before spaces that follow a character that is not white space.

    Such a space always starts a pre-token, and no pre-token looks past the last
    character before it, so pieces can be encoded on their own.
    """
    out, at = [], 0
    while len(text) - at > CHUNK_CHARS:
        end = at + CHUNK_CHARS
        while end > at and (end := text.rfind(" ", at + 1, end)) > 0 and text[end - 1].isspace():
            pass
        if end <= at:
            end = at + CHUNK_CHARS
            while (end := text.find(" ", end + 1)) > 0 and text[end - 1].isspace():
                pass
            if end < 0:
                break
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


@functools.cache
def char_kinds() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, 0 all else."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    chars = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, what in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, f"[{WHITE}]+")):
        for m in regex.finditer(what, chars):
            a, b = m.span()
            kinds[ord(chars[a]) : ord(chars[b - 1]) + 1] = kind
    kinds[0xD800:0xE000] = 0
    return kinds


def cut_gpt2(texts: list[str]) -> Cut:
    """What ``GPT2_PATTERN`` matches, in all texts at once, by character classes and runs."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    data = np.frombuffer(joined.encode(), dtype=np.uint8)
    n = len(cp)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = lengths.cumsum()
    if not n:
        return Cut(data, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64))
    kind = char_kinds()[cp]
    first = np.zeros(n + 4, dtype=bool)  # where a text starts; past the end counts as such
    first[(ends - lengths)[lengths > 0]] = True
    first[n:] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    token = run.copy()
    # the last white space before something else stands alone, or goes to what follows if it is a space
    last = kind == 3
    last[:-1] &= run[1:]
    last &= ~first[1 : n + 1]
    token |= last
    token[1:] &= ~(last & (cp == 32))[:-1]
    # contractions, where a match starts at the apostrophe
    at = np.flatnonzero((cp == 39) & run & token)
    at = at[~first[at + 1]]
    padded = np.concatenate([cp, np.zeros(4, dtype=np.uint32)])
    a, b = padded[at + 1], np.where(first[at + 2], 0, padded[at + 2])
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    token[at[one | two] + 1] = False
    after = np.concatenate([at[one] + 2, at[two] + 3])
    after = after[~first[after]]
    token[after[kind[after] == 1]] = True
    width = 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000)
    start = (width.cumsum() - width)[token]
    upto = np.concatenate([[0], token.cumsum()])
    return Cut(data, start, np.diff(np.append(start, len(data))), upto[ends] - upto[ends - lengths])


def cut_by(pattern: regex.Pattern, texts: list[str]) -> Cut:
    """For any other pattern, which must match every character."""
    split = [[w.encode() for w in pattern.findall(t)] for t in texts]
    words = list(itertools.chain.from_iterable(split))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    return Cut(np.frombuffer(b"".join(words), dtype=np.uint8), size.cumsum() - size, size, counts)


def distinct(cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct pre-tokens, and for each pre-token which of them it equals."""
    padded = np.concatenate([cut.data, np.zeros(16, dtype=np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    some, which, made = [], np.zeros(len(cut.size), dtype=np.int64), 0
    short = np.flatnonzero(cut.size < 8)  # up to 7 bytes and the length are one number
    size = cut.size[short].astype(np.uint64)
    key = (words[cut.start[short]] & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1))) | (size << np.uint64(56))
    _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    some.append(short[at])
    which[short] = inverse
    made += len(at)
    middle = np.flatnonzero((cut.size >= 8) & (cut.size < 16))  # up to 15 bytes and the length are two
    size = cut.size[middle].astype(np.uint64)
    low = words[cut.start[middle]]
    high = (words[cut.start[middle] + 8] & ((np.uint64(1) << ((size - np.uint64(8)) * np.uint64(8))) - np.uint64(1))) | (size << np.uint64(56))
    order = np.lexsort((high, low))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
    some.append(middle[order[new]])
    which[middle[order]] = made + new.cumsum() - 1
    made += int(new.sum())
    seen: dict[bytes, int] = {}
    more = []
    for k in np.flatnonzero(cut.size >= 16).tolist():
        word = cut.data[cut.start[k] : cut.start[k] + cut.size[k]].tobytes()
        if word not in seen:
            seen[word] = made + len(more)
            more.append(k)
        which[k] = seen[word]
    some.append(np.array(more, dtype=np.int64))
    return np.concatenate(some), which


class Found(NamedTuple):
    """Rows that are done: whose they are, how many ids each has, and the ids."""

    owner: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


def _without(matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The matrix with one column a row taken out."""
    keep = np.ones(matrix.shape, dtype=bool)
    keep[np.arange(len(matrix)), column] = False
    return matrix[keep].reshape(len(matrix), matrix.shape[1] - 1)


@functools.lru_cache(maxsize=2)
def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One for each worker process, which Spark uses again for later tasks."""
    return Encoder(rank_file, pattern)


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` the ids and the decoded bytes too."""
    rank_file = read_ranks(rank_path)

    def make():
        bpe = encoder(rank_file, pattern)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode_texts([t or "" for t in part.column("text").to_pylist()])
            decoded = [bpe.decode(x) for x in ids]
            columns = {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(bpe.decimal(x)).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                columns["decoded"] = pa.array(decoded, pa.binary())
            return pa.RecordBatch.from_pydict(columns)

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded binary" if with_ids else ""
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}", rows=BATCH_ROWS)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` as they were, with n_tokens, ids and decoded_sha256 (of what the ids decode to) behind them.

    Where ``docs`` has a column of such a name, the new one has underscores behind its name.
    """
    rank_file = read_ranks(rank_path)
    names = docs.columns
    at = names.index("text")
    added = [StructField(unused(docs, n), t) for n, t in (("n_tokens", LongType()), ("ids", ArrayType(IntegerType())), ("decoded_sha256", StringType()))]

    def make():
        bpe = encoder(rank_file, pattern)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode_texts([t or "" for t in part.column(at).to_pylist()])
            arrays = [part.column(k) for k in range(len(names))]
            extra = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array(ids, pa.list_(pa.int32())),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            return pa.RecordBatch.from_arrays([*arrays, *extra], names=[*names, *(f.name for f in added)])

        return work

    return map_slices(docs, make, StructType([*docs.schema.fields, *added]), rows=BATCH_ROWS)
