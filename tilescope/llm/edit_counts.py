"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: leaves hold some ``LEAF``
pre-tokens with their lengths and token counts, inner nodes the sums of both.  Trees
are columns of a table (``TREE``): ``token_trees`` builds it, ``edit_trees`` reads a
tree back, applies edits and returns the changed tree, which the next edit takes.
Nothing that an edit does not touch is cut or encoded a second time.

An edit descends by character position to its leaf, goes back to the first pre-token
whose match could have seen the edited characters, and cuts pre-tokens anew until
a boundary behind the edit falls on an old one; from there on nothing can differ.
Only the new pre-tokens are encoded (those of all documents of a slice together),
and sums are updated along the path to the root.

Defined results: a null text counts as empty, and its tree has no pre-tokens;
positions and lengths beyond the text are cut to it; null edits or an empty list
change nothing; edits apply one after the other, each to the outcome of the one
before, so edits at one place have the order of the list; texts and pre-tokens of any
length are whole; repeated rows are counted each; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Cut, Encoder, encoder, read_ranks
from .common import map_slices, materialize, scratch, text_of

LEAF = 64
#: Documents whose trees are in memory at a time.
TREE_ROWS = 300
#: Characters behind an edit that are cut anew at first; doubled until old and new boundaries meet.
SLACK = 64


class PieceTree:
    """lengths, counts: characters and tokens of the pre-tokens of ``text``; sizes: pre-tokens of each leaf.

    chars and tokens: the sums, node k over nodes 2k and 2k + 1, the root at 1; made where they are not handed in.
    """

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None, chars: list[int] | None = None, tokens: list[int] | None = None):
        if sizes is None:
            n = max(1, -(-len(lengths) // LEAF))
            sizes = np.zeros(1 << (n - 1).bit_length(), dtype=np.int64)
            sizes[:n] = LEAF
            sizes[n - 1] = len(lengths) - LEAF * (n - 1)
        self.size = len(sizes)
        ends = np.concatenate([[0], sizes.cumsum()])
        if chars is None or tokens is None:
            over = lambda x: np.diff(np.concatenate([[0], x.cumsum()])[ends])
            chars, tokens = self._sums(over(lengths)), self._sums(over(counts))
        self.chars, self.tokens = chars, tokens
        starts = np.concatenate([[0], np.array(chars[self.size :], dtype=np.int64).cumsum()]).tolist()
        self.leaves: list[tuple[str, list[int], list[int]] | None] = [None] * self.size
        self.base = (text, lengths, counts, starts, ends.tolist())

    def _sums(self, leaves: np.ndarray) -> list[int]:
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
        return [0, *np.concatenate(levels[::-1]).tolist()]

    def parts(self) -> tuple[str, np.ndarray, np.ndarray, list[int]]:
        """Text, lengths, counts and leaf sizes as they are now."""
        text, lengths, counts, starts, ends = self.base
        if not any(self.leaves):
            return text, lengths, counts, np.diff(ends).tolist()
        texts, all_lengths, all_counts, sizes = [], [], [], []
        for k, leaf in enumerate(self.leaves):
            texts.append(text[starts[k] : starts[k + 1]] if leaf is None else leaf[0])
            all_lengths.append(lengths[ends[k] : ends[k + 1]] if leaf is None else np.array(leaf[1], dtype=np.int64))
            all_counts.append(counts[ends[k] : ends[k + 1]] if leaf is None else np.array(leaf[2], dtype=np.int64))
            sizes.append(len(all_lengths[-1]))
        return "".join(texts), np.concatenate(all_lengths), np.concatenate(all_counts), sizes

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf(self, k: int) -> tuple[str, list[int], list[int]]:
        if self.leaves[k] is None:
            text, lengths, counts, starts, ends = self.base
            at = slice(ends[k], ends[k + 1])
            self.leaves[k] = (text[starts[k] : starts[k + 1]], lengths[at].tolist(), counts[at].tolist())
        return self.leaves[k]

    def find(self, pos: int) -> tuple[int, int]:
        """The leaf with character ``pos``, and where in the text the leaf starts."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if pos >= before + self.chars[at] and self.chars[at + 1]:
                before += self.chars[at]
                at += 1
        return at - self.size, before

    def set_leaf(self, k: int, leaf: tuple[str, list[int], list[int]]) -> None:
        self.leaves[k] = leaf
        at = k + self.size
        chars, tokens = len(leaf[0]) - self.chars[at], sum(leaf[2]) - self.tokens[at]
        while at:
            self.chars[at] += chars
            self.tokens[at] += tokens
            at //= 2

    def text(self) -> str:
        return self.parts()[0]

    def edit(self, pattern, at: int, n: int, put: str) -> tuple[int, list[str]] | None:
        """Cut anew around an edit.  Returns the leaf that waits for the counts of its pre-tokens, and the new ones."""
        whole = self.chars[1]
        at = min(max(at, 0), whole)
        n = min(max(n, 0), whole - at)
        if not n and not put:
            return None
        # two characters before the edit: a match may have seen the edited ones from there
        first, start = self.find(max(0, at - 2))
        text, lengths, counts = self.leaf(first)
        last, pieces, old_lengths, old_counts = first, [text], list(lengths), list(counts)
        slack = SLACK
        while True:
            while start + len(text) < min(whole, at + n + slack) and last + 1 < self.size:
                last += 1
                more, more_lengths, more_counts = self.leaf(last)
                text += more
                old_lengths += more_lengths
                old_counts += more_counts
            at_end = start + len(text) >= whole
            edit_at = at - start
            new = text[:edit_at] + put + text[edit_at + n :]
            shift = len(put) - n
            # pre-tokens that end before the edit by two characters or more stay
            keep, upto = 0, 0
            while keep < len(old_lengths) and upto + old_lengths[keep] + 1 < edit_at:
                upto += old_lengths[keep]
                keep += 1
            bounds, total = {}, 0
            for k, size in enumerate(old_lengths):
                bounds[total + shift] = k
                total += size
            fresh, pos, back = [], upto, None
            for m in pattern.finditer(new, upto):
                if pos >= edit_at + len(put) and pos in bounds and (at_end or pos + 2 < len(new)):
                    back = bounds[pos]
                    break
                if not at_end and m.end() + 2 >= len(new):
                    break
                fresh.append(m[0])
                pos = m.end()
            else:
                if at_end and pos == len(new):
                    back = len(old_lengths)
            if back is not None:
                break
            slack *= 2
        lengths = old_lengths[:keep] + [len(w) for w in fresh] + old_lengths[back:]
        counts = old_counts[:keep] + [0] * len(fresh) + old_counts[back:]
        for k in range(first + 1, last + 1):
            self.set_leaf(k, ("", [], []))
        self.set_leaf(first, (new, lengths, counts))
        self.waiting = (first, keep)
        return first, fresh

    def fill(self, counts: list[int]) -> None:
        first, keep = self.waiting
        text, lengths, old = self.leaf(first)
        self.set_leaf(first, (text, lengths, old[:keep] + counts + old[keep + len(counts) :]))

    def grown(self) -> bool:
        return self.leaves[self.waiting[0]] is not None and len(self.leaves[self.waiting[0]][1]) > 8 * LEAF


def trees(bpe: Encoder, texts: list[str]) -> list[PieceTree]:
    cut = bpe.cut(texts)
    counts = bpe.encode_cut(cut).size
    starts_char = np.concatenate([[0], ((cut.data & 0xC0) != 0x80).cumsum()])
    lengths = starts_char[cut.start + cut.size] - starts_char[cut.start]
    ends = cut.counts.cumsum()
    return [PieceTree(t, lengths[a:b], counts[a:b]) for t, a, b in zip(texts, (ends - cut.counts).tolist(), ends.tolist(), strict=True)]


def count_words(bpe: Encoder, words: list[str]) -> list[int]:
    if not words:
        return []
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return bpe.encode_cut(Cut(data, size.cumsum() - size, size, np.array([len(raw)]))).size.tolist()


def edit_all(bpe: Encoder, found: list[PieceTree], edits: list[list[tuple[int, int, str]]]) -> list[int]:
    """Apply each document's edits to its tree (trees that grew uneven are dealt anew); pre-tokens encoded anew."""
    anew = [0] * len(found)
    for k in range(max(map(len, edits), default=0)):
        waiting, words = [], []
        for d, (tree, some) in enumerate(zip(found, edits, strict=True)):
            if k < len(some) and (change := tree.edit(bpe.pattern, *some[k])) is not None:
                waiting.append((d, len(change[1])))
                words += change[1]
        counts, at = count_words(bpe, words), 0
        for d, n in waiting:
            found[d].fill(counts[at : at + n])
            anew[d] += n
            at += n
            if found[d].grown():  # leaves have grown out of proportion: deal the pre-tokens out again
                found[d] = PieceTree(*found[d].parts()[:3])
    return anew


def apply_edits(bpe: Encoder, texts: list[str], edits: list[list[tuple[int, int, str]]]) -> list[tuple[int, int, int, PieceTree]]:
    """(tokens before, tokens after, pre-tokens encoded anew, tree) of each text."""
    found = trees(bpe, texts)
    before = [t.total for t in found]
    anew = edit_all(bpe, found, edits)
    return [(b, t.total, a, t) for b, t, a in zip(before, found, anew, strict=True)]


#: A tree as a column: lengths and counts by pre-token, sizes by leaf, sums by node.
TREE = "struct<lengths:array<int>,counts:array<int>,sizes:array<int>,chars:array<bigint>,tokens:array<bigint>>"


def tree_column(some: list[PieceTree]) -> tuple[pa.Array, pa.Array]:
    """Texts and trees of a batch."""
    parts = [t.parts() for t in some]
    many = lambda rows, kind: pa.array(rows, pa.list_(kind))
    columns = [
        many([np.asarray(p[1], dtype=np.int32) for p in parts], pa.int32()),
        many([np.asarray(p[2], dtype=np.int32) for p in parts], pa.int32()),
        many([p[3] for p in parts], pa.int32()),
        many([t.chars for t in some], pa.int64()),
        many([t.tokens for t in some], pa.int64()),
    ]
    return pa.array([p[0] for p in parts], pa.string()), pa.StructArray.from_arrays(columns, ["lengths", "counts", "sizes", "chars", "tokens"])


def read_trees(texts: pa.Array, column: pa.StructArray) -> list[PieceTree]:
    def arrays(name: str) -> list[np.ndarray]:
        lists = column.field(name)
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        return [values[a:b].astype(np.int64) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    rows = zip(texts.to_pylist(), *map(arrays, ("lengths", "counts", "sizes", "chars", "tokens")), strict=True)
    return [PieceTree(t, lengths, counts, sizes, chars.tolist(), tokens.tolist()) for t, lengths, counts, sizes, chars, tokens in rows]


def token_trees(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, text (null as empty), tree, n_tokens: a tree for each row of ``docs``."""
    rank_file = read_ranks(rank_path)

    def make():
        bpe = encoder(rank_file, pattern)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = trees(bpe, [t or "" for t in part.column("text").to_pylist()])
            texts, column = tree_column(found)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), texts, column, pa.array([t.total for t in found], pa.int64())], ["doc_id", "text", "tree", "n_tokens"])

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {kind}, text string, tree {TREE}, n_tokens bigint", rows=TREE_ROWS)


def edit_trees(held: DataFrame, rank_path: str, pattern: str, edits: Column) -> DataFrame:
    """held: doc_id, text, tree.  The same with the edits applied, and n_edits, n_tokens_before, n_tokens, n_encoded_anew.

    edits: array of (at, n, put) in code points, as a column over ``held``.
    """
    rank_file = read_ranks(rank_path)

    def make():
        bpe = encoder(rank_file, pattern)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = read_trees(part.column("text"), part.column("tree"))
            scripts = [[(e["at"] or 0, e["n"] or 0, e["put"] or "") for e in some or [] if e] for some in part.column("edits").to_pylist()]
            before = [t.total for t in found]
            anew = edit_all(bpe, found, scripts)
            texts, column = tree_column(found)
            numbers = [list(map(len, scripts)), before, [t.total for t in found], anew]
            names = ["doc_id", "text", "tree", "n_edits", "n_tokens_before", "n_tokens", "n_encoded_anew"]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), texts, column, *[pa.array(x, pa.int64()) for x in numbers]], names)

        return work

    kind = held.schema["doc_id"].dataType.simpleString()
    more = "n_edits bigint, n_tokens_before bigint, n_tokens bigint, n_encoded_anew bigint"
    return map_slices(held.select("doc_id", "text", "tree", edits.alias("edits")), make, f"doc_id {kind}, text string, tree {TREE}, {more}", rows=TREE_ROWS)


def sample_edits(n: int = 3) -> Column:
    """A made-up edit script for each document: replacements, insertions and deletions at hashed places."""
    size = F.length(text_of()) + 1
    words = F.array(*[F.lit(w) for w in ("", " and", "It's", "\n\n", " 1234", "é", "  ", "whole new words, ")])
    one = lambda k: F.struct(
        F.pmod(F.xxhash64(F.lit(3 * k), "doc_id"), size).cast("int").alias("at"),
        F.pmod(F.xxhash64(F.lit(3 * k + 1), "doc_id"), F.lit(16)).cast("int").alias("n"),
        F.element_at(words, (F.pmod(F.xxhash64(F.lit(3 * k + 2), "doc_id"), F.lit(8)) + 1).cast("int")).alias("put"),
    )
    return F.array(*[one(k) for k in range(n)])


def edited_counts(docs: DataFrame, rank_path: str, pattern: str, edits: Column | None = None) -> DataFrame:
    """doc_id, n_edits, n_tokens (before), n_tokens_edited, n_encoded_anew: trees are stored, read back and edited.

    edits: as in ``edit_trees``; by default ``sample_edits``.
    """
    with scratch(docs.sparkSession):
        held = materialize(token_trees(docs, rank_path, pattern), "token-trees", texts=True)
        done = edit_trees(held, rank_path, pattern, edits if edits is not None else sample_edits())
        counts = done.select("doc_id", "n_edits", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_encoded_anew")
        return materialize(counts, "edited-counts", last=True)
