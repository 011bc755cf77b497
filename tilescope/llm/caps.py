"""Embedding near-dedup by spherical-cap filters.

A filter is a direction; a vector passes it if their scalar product is high
enough, so vectors that are close pass common filters.  The filters are a random
product code: the dimensions are cut into two blocks, each with a structured code
(unions of random orthogonal bases), and a filter is a pair of code words.  Which
filters a vector passes is list-decoded: code words of a block are taken by
falling score, and only while the best partner can still reach the threshold.  A
vector passes all filters over the threshold and at least its ``LEAST_FILTERS``
best.  Rows are joined on (label, filter), and every pair is verified by cosine in
double precision, once: in the smallest filter that both pass.

The code of a label grows with the number of its vectors, so a filter holds at most
about ``TARGET`` unrelated vectors, up to 4,096 words a block and more beyond.  A
larger code needs more filters a vector for the same recall: its threshold is the
one that random pairs at a cosine of exactly 0.93 reach with a common filter in
``RECALL`` of the cases, by simulation, or the one that ``FILTERS`` filters pass if
that is lower.  Recall is higher above 0.93.  Equal vectors are collapsed beforehand, by
MD5.  Members of a filter are compared in blocks, as matrix products; no pairs are
emitted, only counts of links and, for each member, the smallest member it hangs
together with.  A vector travels once to each filter that it passes.

Defined results: vectors that are null, zero or hold null or non-finite components,
a null label and a null ``vec_id`` link with nothing; a vector of another width
than the first is compared only with vectors of its own width; repeated rows link
with each other; rows that share a ``vec_id`` but not a vector are nodes of their own;
``vec_id`` may be of any type that has an order, and a component is named by its
smallest; an empty table gives an empty result; very long vectors are
compared whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_dealt, map_slices, materialize, scratch, small_batches, whole_groups
from .components import components

COSINE = 0.93
FILTERS, LEAST_FILTERS = 20, 8
RECALL = 0.999
#: Random pairs that a threshold is simulated with, and the code words a block looked at for each.
SIMULATED, LOOKED_AT = 4000, 64
LEAST_WORDS, MOST_WORDS = 16, 4096
#: Width for which the filters a vector passes are estimated when a label's code is sized.
SIZED_FOR = 64
TARGET = 256
BLOCK = 1024
SEED = 93


def usable(vector: str = "embedding") -> Column:
    """Not null, not zero, all components finite."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda e: e != 0), F.lit(False))


def structured_code(width: int, words: int, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors: random orthogonal bases and their negatives."""
    parts: list[np.ndarray] = []
    while sum(map(len, parts)) < words:
        q, _ = np.linalg.qr(rng.standard_normal((width, width)))
        parts += [q, -q]
    return np.vstack(parts)[:words]


def pairs_at(cosine: float, n: int, width: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of random unit vectors at this cosine."""
    a, z = rng.standard_normal((2, n, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z -= (z * a).sum(axis=1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    return a, cosine * a + (1 - cosine**2) ** 0.5 * z


class Code:
    def __init__(self, width: int, words: int):
        rng = np.random.default_rng([SEED, width, words])
        self.cut = max(1, width // 2)
        self.words = words
        self.blocks = [structured_code(n, words, rng) for n in (self.cut, width - self.cut) if n]
        tail = min(0.5, FILTERS / words ** len(self.blocks))
        self.threshold = NormalDist().inv_cdf(1 - tail) * (len(self.blocks) / width) ** 0.5
        if width > 1:
            self.threshold = min(self.threshold, self.simulated(width, rng))

    def least(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Score of each vector's last of its ``LEAST_FILTERS`` best filters, from its best scores in each block."""
        best = (first[:, :, None] + second[:, None, :]).reshape(len(first), -1)
        k = min(LEAST_FILTERS, best.shape[1])
        return np.partition(best, -k, axis=1)[:, -k]

    def simulated(self, width: int, rng: np.random.Generator) -> float:
        """Threshold at which ``RECALL`` of random pairs at a cosine of ``COSINE`` pass a common filter."""
        top = lambda x: -np.partition(-x, LEAST_FILTERS - 1, axis=1)[:, :LEAST_FILTERS]
        a, b = pairs_at(COSINE, SIMULATED, width, rng)
        reached = []
        for s in range(0, SIMULATED, 100):
            (x, y), (u, v) = [
                (a[s : s + 100, cols] @ code.T, b[s : s + 100, cols] @ code.T)
                for code, cols in zip(self.blocks, (slice(None, self.cut), slice(self.cut, None)), strict=True)
            ]
            least = self.least(top(x), top(u)), self.least(top(y), top(v))
            # a common filter of high scores has a high sum; leaving words out can only lower the threshold
            one, two = np.argsort(-(x + y), axis=1)[:, :LOOKED_AT], np.argsort(-(u + v), axis=1)[:, :LOOKED_AT]
            x, y, u, v = (np.take_along_axis(z, at, 1) for z, at in ((x, one), (y, one), (u, two), (v, two)))
            of_a, of_b = ((p[:, :, None] + q[:, None, :]).reshape(len(p), -1) for p, q in ((x, u), (y, v)))
            # filters that both pass as their best need no threshold
            free = ((of_a >= least[0][:, None]) & (of_b >= least[1][:, None])).any(axis=1)
            reached.append(np.where(free, np.inf, np.minimum(of_a, of_b).max(axis=1)))
        return float(np.sort(np.concatenate(reached))[int((1 - RECALL) * SIMULATED)])

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and filters of all exceeding filter directions of unit vectors, by row and filter."""
        first = vectors[:, : self.cut] @ self.blocks[0].T
        second = vectors[:, self.cut :] @ self.blocks[1].T if len(self.blocks) > 1 else np.zeros((len(vectors), 1))
        by_first, by_second = np.argsort(-first, axis=1), np.argsort(-second, axis=1)
        first, second = np.take_along_axis(first, by_first, 1), np.take_along_axis(second, by_second, 1)
        least = np.minimum(self.threshold, self.least(first[:, :LEAST_FILTERS], second[:, :LEAST_FILTERS]))
        rows, filters = [], []
        for rank in range(first.shape[1]):
            going = np.flatnonzero(first[:, rank] + second[:, 0] >= least)
            if not len(going):
                break
            hit, at = np.nonzero(first[going, rank, None] + second[going] >= least[going, None])
            rows.append(going[hit])
            filters.append(by_first[going[hit], rank] * second.shape[1] + by_second[going[hit], at])
        rows, filters = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]


@cache
def code_for(width: int, words: int) -> Code:
    return Code(width, words)


@cache
def filters_of(words: int) -> float:
    """Filters that a random vector passes, in the mean."""
    x = np.random.default_rng([SEED, words]).standard_normal((500, SIZED_FOR))
    return len(code_for(SIZED_FOR, words).decode(x / np.linalg.norm(x, axis=1)[:, None])[0]) / len(x)


def words_for(vectors: int) -> int:
    """Code words a block, a power of two, from how many vectors the label has."""
    words = LEAST_WORDS
    while words < MOST_WORDS and vectors * filters_of(words) > TARGET * words**2:
        words *= 2
    return words


def words_column(vectors: Column, largest: int) -> Column:
    """``words_for`` as a column, for labels of up to ``largest`` vectors."""
    out, words = F.lit(LEAST_WORDS), LEAST_WORDS
    while words < words_for(largest):
        out = F.when(vectors * F.lit(filters_of(words)) > TARGET * words**2, F.lit(2 * words)).otherwise(out)
        words *= 2
    return out


def number_type(vectors: DataFrame) -> type:
    """Components travel as they came: float, or double if they are of any wider type."""
    return np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def passed_filters(classes: DataFrame) -> DataFrame:
    """classes: node, label, copies, embedding, words (of the label's code).

    node, label, copies, vector (bytes of its components), width, filters (all that it passes): a row for each class.
    """
    number = number_type(classes)

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            raw = [np.array(v, dtype=np.float64) for v in part.column("embedding").to_pylist()]
            widths, words = np.array([len(v) for v in raw]), part.column("words").to_numpy()
            lists: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(raw)
            for width, size in np.unique(np.stack([widths, words], axis=1), axis=0).tolist():
                some = np.flatnonzero((widths == width) & (words == size))
                matrix = np.vstack([raw[k] for k in some])
                matrix /= np.abs(matrix).max(axis=1)[:, None]
                matrix /= np.linalg.norm(matrix, axis=1)[:, None]
                row, found = code_for(width, size).decode(matrix)
                for k, ids in zip(some.tolist(), np.split(found.astype(np.int32), np.flatnonzero(np.diff(row)) + 1), strict=True):
                    lists[k] = ids
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            return pa.RecordBatch.from_pydict(
                {
                    "node": part.column("node"),
                    "label": part.column("label"),
                    "copies": part.column("copies"),
                    "width": pa.array(widths, pa.int32()),
                    "vector": pa.array([v.astype(number).tobytes() for v in raw], pa.binary()),
                    "filters": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))),
                }
            )

        return work

    schema = "node bigint, label string, copies bigint, width int, vector binary, filters array<int>"
    return map_slices(classes.select("node", F.col("label").cast("string").alias("label"), "copies", "embedding", "words"), make, schema)


def verify_group(low: np.ndarray, high: np.ndarray, same: bool, node: np.ndarray, copies: np.ndarray, vectors: np.ndarray, norms: np.ndarray, filters: list[np.ndarray], here: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one filter, members ``low`` against ``high``: (member, links found here, smallest node it hangs together with)."""
    linked = (vectors[low] @ vectors[high].T) / (norms[low][:, None] * norms[high][None, :]) >= COSINE
    if same:
        np.fill_diagonal(linked, False)
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    if not rows.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    low, high, linked = low[rows], high[cols], linked[np.ix_(rows, cols)]
    # a pair counts in the smallest filter that both pass
    before = [np.unique(np.concatenate([f[f < here] for f in (filters[k] for k in side)] or [np.empty(0, dtype=np.int32)])) for side in (low, high)]
    shared = np.intersect1d(*before, assume_unique=True)
    def passes(side: np.ndarray) -> np.ndarray:
        out = np.zeros((len(side), len(shared)), dtype=np.float32)
        for r, k in enumerate(side.tolist()):
            out[r, np.searchsorted(shared, np.intersect1d(filters[k], shared, assume_unique=True))] = 1
        return out
    counted = linked & (passes(low) @ passes(high).T == 0) if len(shared) else linked
    members = low if same else np.concatenate([low, high])
    links = counted @ copies[high] if same else np.concatenate([counted @ copies[high], counted.T @ copies[low]])
    # labels of local components
    a, b = node[low].copy(), node[high].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1))
        if same:
            new_b = new_a
        else:
            new_b = np.minimum(b, np.where(linked, new_a[:, None], top).min(axis=0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    return members, links, a if same else np.concatenate([a, b])


def dealt_by_filter(passed: DataFrame) -> DataFrame:
    """A row for each class, filter and pair of blocks: group, filter, low, high, block and the class.

    A filter of over ``BLOCK`` members is cut into blocks by a hash, and every two of its blocks are a group.
    """
    one_each = passed.select("label", "width", F.explode("filters").alias("filter"), "node")
    full = one_each.groupBy("label", "width", "filter").count().where(F.col("count") > BLOCK)
    full = materialize(full.select("label", "width", "filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "caps-full")
    rows = passed.withColumn("filter", F.explode("filters"))
    if full.limit(1).count():  # one for every BLOCK rows at most; Spark's size check decides whether it is broadcast
        rows = rows.join(full, ["label", "width", "filter"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        rows = rows.withColumn("blocks", F.lit(1))
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .withColumn("group", F.xxhash64("label", "width", "filter", "low", "high"))
        .select("group", "filter", "low", "high", "block", "node", "copies", "width", "label", "vector", "filters")
    )


def verified(passed: DataFrame, number: type) -> DataFrame:
    """node, links, least: what each filter, or pair of blocks of one, finds about its members."""
    keys = ["group", "filter", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys, rows=4096):
            num = lambda c: rows.column(c).to_numpy()
            group, here, low, high, block, node, copies, width = map(num, (*keys, "block", "node", "copies", "width"))
            label = rows.column("label").to_pylist()
            raw, lists = rows.column("vector").to_pylist(), rows.column("filters").combine_chunks()
            ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            new = np.ones(len(group), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (here[1:] != here[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            starts = np.flatnonzero(new)
            out = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
                kinds = sorted({(label[k], int(width[k])) for k in range(s, e)})
                for kind in kinds:  # more than one only if two groups have the same hash
                    at = np.array([k for k in range(s, e) if (label[k], width[k]) == kind])
                    if len(at) < 2:
                        continue
                    vectors = np.frombuffer(b"".join(raw[k] for k in at), dtype=number).reshape(len(at), -1).astype(np.float64)
                    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
                    filters = [ids[ends[k] : ends[k + 1]] for k in at.tolist()]
                    same = bool(low[s] == high[s])
                    left = np.flatnonzero(block[at] == low[s])
                    right = left if same else np.flatnonzero(block[at] == high[s])
                    found = verify_group(left, right, same, node[at], copies[at], vectors, np.linalg.norm(vectors, axis=1), filters, int(here[s]))
                    if len(found[0]):
                        out.append((node[at][found[0]], found[1], found[2]))
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k, n in enumerate(("node", "links", "least"))})

    small_batches(passed.sparkSession)
    return dealt_by_filter(passed).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node bigint, links bigint, least bigint")


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """One row for each row of ``embeddings``: vec_id, n_links, component_id, kept."""
    with scratch(embeddings.sparkSession):
        return materialize(_near_vectors(embeddings), "caps-vectors", last=True)


def _near_vectors(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", "embedding", "label")
    usable_row = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # what a vector is joined by: 128 bits of its label and its components as they are written in full
    said = F.concat_ws("|", F.col("embedding").cast("string"), F.col("label").cast("string"))
    rows = rows.withColumn("sum", F.when(usable_row, F.unhex(F.md5(said.cast("binary")))))
    some = rows.where("sum is not null").groupBy("sum").agg(
        F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    classes = materialize(some.withColumn("node", F.monotonically_increasing_id()), "caps-classes")
    sizes = materialize(classes.groupBy("label").count(), "caps-sizes")
    largest = sizes.agg(F.max("count")).first()[0] or 1
    # a label's own size decides, so only the few labels that need more than the least code are looked up
    sized = sizes.select("label", words_column(F.col("count"), largest).alias("words")).where(f"words > {LEAST_WORDS}")
    coded = classes.join(sized, "label", "left").fillna(LEAST_WORDS, ["words"])
    passed = materialize(passed_filters(coded), "caps-passed")
    found = materialize(verified(passed, number_type(classes)), "caps-links")
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    hang = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    linked = classes.select("node", "sum", "first_id", "copies").join(degrees, "node", "left").join(hang, "node", "left")
    linked = materialize(linked.withColumn("component", F.coalesce("component", "node")), "caps-linked")
    # nodes are numbers of this run; a component is named by its smallest identifier
    names = materialize(linked.groupBy("component").agg(F.min("first_id").alias("name"), F.count(F.lit(1)).alias("n")), "caps-names")
    known = join_dealt(linked, names, "component", "n", ["node"])
    known = materialize(known.select("sum", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("name").alias("component_id")), "caps-known")
    named = join_dealt(rows.where("sum is not null").select("vec_id", "sum"), known, "sum", "copies", ["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("sum is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
