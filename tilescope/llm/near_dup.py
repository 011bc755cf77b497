"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

1. Each document's set of word shingles gives a signature of ``SYMBOLS`` b-bit
   minimum hashes.  Documents with equal sets form a class; classes are joined.
2. Two signatures are near if they differ in at most ``MAX_WRONG`` symbols.  Split
   into ``CHUNKS`` chunks, a near pair has a chunk with at most ``CHUNK_WRONG``
   wrong symbols (pigeonhole).  The allowed errors are enumerated: every choice of
   ``CHUNK_WRONG`` symbols of a chunk is left out and the rest is a key, so every
   near pair shares a key.  Chance of a pair at similarity 0.75 not to be near:
   under 1 in 10,000.
3. Links are confirmed on full shingle sets, in two steps.  First each key's
   members are paired with its smallest member; what is confirmed is merged into
   components.  Then, of keys whose members still lie in several components, all
   pairs across components that are near by signature are compared, each once, in
   the first key that both have, by their sketches: the ``SKETCH`` smallest hashes of
   a set, which for a smaller set are all of it.  A sketch rules a pair out only if
   the sets could not be a link even if they shared all that it does not show; the
   rest is confirmed.  A pair inside a component adds nothing, so a key that
   thousands of near copies share costs thousands of confirmations, not millions.

Members of a hot key are dealt over tasks wherever they are joined; in the second step
they are cut into blocks by a hash, and blocks are paired, so a task holds about
``2 * BLOCK`` members of a key.

Defined results: a null text counts as empty; a document without words has an
empty set, is linked with nothing and is its own component; repeated rows and
rows that share a ``doc_id`` are one document; a null ``doc_id`` takes part in
links, and its component is the smallest non-null identifier reachable or else
null; ``doc_id`` may be of any type that has an order, and where it is no whole number
classes are numbered by 64 bits of their set's hash; texts are whole, of any length;
an empty table gives an empty result; other columns, whatever their names, are not
read by ``near_groups`` and come through ``drop_near`` as they were.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StructField, StructType

from .common import join_dealt, map_slices, materialize, scratch, slices, small_batches, text_of, unused, whole_groups
from .components import components

SHINGLE = 5
#: A link: 100 * shared >= PERCENT * united.
PERCENT = 75
SYMBOLS, CHUNKS, CHUNK_WRONG = 30, 6, 2
WIDTH = SYMBOLS // CHUNKS
MAX_WRONG = CHUNKS * (CHUNK_WRONG + 1) - 1
BLOCK = 1024
#: Hashes of a set that the second step compares before whole sets are.
SKETCH = 256
#: Memoised hashes of words, a worker.
MEMO_WORDS = 400_000

_RNG = np.random.default_rng(20260101)
_MULTIPLY = _RNG.integers(1, 2**63, size=SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, size=SYMBOLS, dtype=np.uint64)
_STEP = _RNG.integers(1, 2**63, size=SHINGLE, dtype=np.uint64) | np.uint64(1)
_LEFT_IN = [c for c in itertools.combinations(range(WIDTH), WIDTH - CHUNK_WRONG)]


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_HASHES = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - SHINGLE + 1)
    total = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, dtype=np.uint64)
    for k in range(min(SHINGLE, len(words))):
        total = _mix(total + hashes[k : k + n] * _STEP[k])
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` minimum hashes, 32 bits of each."""
    out = np.empty(SYMBOLS, dtype=np.uint32)
    for k in range(SYMBOLS):
        # multiply-add on hashes that are mixed already; the minimum of the high bits
        out[k] = ((found * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).min()
    return out


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) -> (rows, keys): of each chunk, every choice of symbols left in."""
    wide = signatures.astype(np.uint64)
    out = np.empty((len(wide), CHUNKS * len(_LEFT_IN)), dtype=np.uint64)
    for k, (chunk, some) in enumerate(itertools.product(range(CHUNKS), _LEFT_IN)):
        total = np.full(len(wide), k + 1, dtype=np.uint64)
        for j in some:
            total = _mix(total + wide[:, chunk * WIDTH + j] * _STEP[j % SHINGLE])
        out[:, k] = total
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set), signature; both null for an empty set."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(t) for t in part.column("text").to_pylist()]
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array(map(len, found), pa.int64()),
                    "set_hash": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found], pa.binary()),
                    "signature": pa.array([signature(x).tobytes() if len(x) else None for x in found], pa.binary()),
                }
            )

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_shingles bigint, set_hash binary, signature binary")


def dealt_keys(classes: DataFrame) -> DataFrame:
    """key, node: all keys of each class."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            raw = b"".join(part.column("signature").to_pylist())
            keys = keys_of(np.frombuffer(raw, dtype=np.uint32).reshape(part.num_rows, SYMBOLS))
            nodes = part.column("node").to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), "node": pa.array(np.repeat(nodes, keys.shape[1]))})

        return work

    return map_slices(classes.select("node", "signature"), make, "key bigint, node bigint", rows=1000)


def key_members(classes: DataFrame) -> DataFrame:
    """key, node, first (the smallest node of the key), members, of keys that several nodes share; hot keys are dealt."""
    dealt = dealt_keys(classes)
    shared = dealt.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return join_dealt(dealt, materialize(shared, "near-shared"), "key", "members", ["node"])


def _near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """By signature and by size; arrays of signatures that broadcast against each other."""
    wrong = (a != b).sum(axis=-1)
    return (wrong <= MAX_WRONG) & (100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b))


def near_only(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that are near by signature."""
    side = lambda n: classes.select(F.col("node").alias(n), F.col("signature").alias(f"sig_{n}"), F.col("n_shingles").alias(f"size_{n}"))

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            sig = lambda c: np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint32).reshape(-1, SYMBOLS)
            size = lambda c: part.column(c).to_numpy(zero_copy_only=False)
            keep = _near(sig("sig_a"), sig("sig_b"), size("size_a"), size("size_b"))
            return part.select(["a", "b"]).filter(pa.array(keep))

        return work

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b", "size_a", "size_b")
    return map_slices(joined, make, "a bigint, b bigint", rows=1000)


def confirmed(pairs: DataFrame, texts: DataFrame, many: bool) -> DataFrame:
    """Of pairs (a, b) those whose full shingle sets make a link.  texts: node, text.

    many: whether pairs grow with the documents, so that texts are dealt by node at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for part in slices(batches):
            keep = []
            for a, text_a, text_b in zip(part.column("a").to_pylist(), part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                if a != last:
                    last, last_set = a, shingles(text_a)
                other = shingles(text_b)
                shared = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(last_set) + len(other) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = texts.hint("merge") if many else texts
    side = lambda n: dealt.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    joined = side("b").join(pairs, "b").join(side("a"), "a").sortWithinPartitions("a").select("a", "b", "text_a", "text_b")
    small_batches(pairs.sparkSession)
    return joined.mapInArrow(run, "a bigint, b bigint")


def sketches(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, sketch (the smallest hashes of its set, 32 bits of each) of the nodes asked for."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [(shingles(t)[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for t in part.column("text").to_pylist()]
            return pa.RecordBatch.from_pydict({"node": part.column("node"), "sketch": pa.array(found, pa.binary())})

        return work

    return map_slices(texts.join(nodes.hint("merge"), "node", "left_semi").select("node", "text"), make, "node bigint, sketch binary")


def _ruled_out(one: np.ndarray, size_one: int, others: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of ``others`` (a row each, filled up beyond ``length``) cannot be a link of ``one``, by their sketches."""
    top = np.uint64(1 << 32)
    inside = np.arange(others.shape[1]) < length[:, None]
    # beyond the last hash of a cut sketch nothing is known
    end = np.where(size > SKETCH, others[np.arange(len(others)), length - 1].astype(np.uint64), top)
    if size_one > SKETCH:
        end = np.minimum(end, np.uint64(one[-1]))
    inside &= others <= end[:, None]
    at = np.minimum(np.searchsorted(one, others.ravel()), len(one) - 1)
    shared = ((one[at] == others.ravel()).reshape(others.shape) & inside).sum(axis=1)
    # at best all that is not known is shared too
    rest = np.minimum(size_one - np.searchsorted(one, end.astype(np.float64), side="right"), size - inside.sum(axis=1))
    most = shared + np.maximum(rest, 0)
    return 100 * most < PERCENT * (size_one + size - most)


def pairs_across(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a key, lie in different components and are not ruled out.

    members: key, members (how many), node, component, of keys with members in several components.
    """
    members = materialize(members, "near-mixed")
    known = materialize(sketches(texts, members.select("node").distinct()), "near-sketches").dropDuplicates(["node"])
    blocks = (
        members.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component")
    )
    about = classes.select("node", "signature", "n_shingles").join(known, "node")
    dealt = blocks.join(about, "node").select("key", "low", "high", "block", "node", "component", "signature", "n_shingles", "sketch")

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """rows: whole (key, low, high) groups, sorted."""
        num = lambda c: rows.column(c).to_numpy()
        sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, SYMBOLS)
        raw = [np.frombuffer(x, dtype=np.uint32) for x in rows.column("sketch").to_pylist()]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        filled = np.full((len(raw), SKETCH), 0xFFFFFFFF, dtype=np.uint32)
        filled[np.arange(SKETCH) < length[:, None]] = np.concatenate(raw)
        key, low, high, block, node, comp, size = map(num, ("key", "low", "high", "block", "node", "component", "n_shingles"))
        keys = keys_of(sig)
        turn = (keys == key[:, None]).argmax(axis=1)
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.flatnonzero(new)
        for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
            here = np.arange(s, e)
            kinds, sizes = np.unique(comp[s:e], return_counts=True)
            if len(kinds) < 2:
                continue
            # the members of the most frequent component meet only those outside it
            most = kinds[sizes.argmax()]
            for i in here[comp[s:e] != most].tolist():
                others = here[(comp[s:e] != comp[i]) & ((comp[s:e] == most) | (node[s:e] > node[i]))]
                if low[s] != high[s]:
                    others = others[block[others] != block[i]]
                others = others[_near(sig[others], sig[i], size[others], size[i])]
                # each pair once: in the first key that both have
                others = others[(keys[others] == keys[i]).argmax(axis=1) == turn[i]]
                if len(others):
                    others = others[~_ruled_out(raw[i], int(size[i]), filled[others], length[others], size[others])]
                if len(others):
                    a, b = np.minimum(node[i], node[others]), np.maximum(node[i], node[others])
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    order = ["key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, order, rows=4096):
            yield from pairs_of(rows)

    small_batches(members.sparkSession)
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    with scratch(docs.sparkSession):
        return materialize(_near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept"), "near-groups", last=True)


def _near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_hash, leads (whether its set is its component's smallest node)."""
    rows = materialize(signed(docs), "near-signed")
    # a class: one set; its node number is its smallest doc_id, or a negative hash where it has no whole number for one
    classes = rows.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("rows"))
    numbered = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    by_hash = -F.abs(F.xxhash64("set_hash")) - 1
    node = F.coalesce(F.col("least").cast("long"), by_hash) if numbered else by_hash
    classes = materialize(classes.withColumn("node", node), "near-classes")
    members = materialize(key_members(classes), "near-keys")
    if numbered:
        texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
        if docs.where("doc_id is null").limit(1).count():
            texts = texts.unionByName(_nameless_texts(docs.where("doc_id is null").select("text")))
    else:
        texts = _nameless_texts(docs.select("text"))
    texts = texts.withColumn("text", text_of())
    # of whole texts only those are looked at again that share a key; they are dealt by node at every size
    texts = materialize(texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "near-texts")
    star = members.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    linked = materialize(confirmed(materialize(near_only(star, classes), "near-stars"), texts, many=True), "near-links")
    found = materialize(components(linked), "near-components")
    rest = members.where("members > 2").select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("members")).where("least <> most")
    rest = join_dealt(rest, materialize(mixed.select("key", "members"), "near-mixed-keys"), "key", "members", ["node"])
    across = materialize(pairs_across(rest.select("key", "members", "node", "component"), classes, texts), "near-across")
    if across.limit(1).count():
        more = materialize(confirmed(across, texts, many=False), "near-more")
        if more.limit(1).count():
            # components so far stand in for the links that made them
            found = materialize(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "near-components")
    return _by_row(rows, classes, found)


def _hashed(docs: DataFrame) -> DataFrame:
    """The hash of the set (null for an empty one), the text and the whole row of each row, as _ts_hash, text, row."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x := shingles(t)) else None for t in part.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), *part.columns], ["_ts_hash", *part.schema.names])

        return work

    return map_slices(docs, make, StructType([StructField("_ts_hash", BinaryType()), *docs.schema.fields]))


def _nameless_texts(nameless: DataFrame) -> DataFrame:
    """node, text of rows without doc_id; nodes that a named document stands for are never asked for."""
    hashed = _hashed(nameless.select("text")).where("_ts_hash is not null").dropDuplicates(["_ts_hash"])
    return hashed.select((-F.abs(F.xxhash64("_ts_hash")) - 1).alias("node"), "text")


def _by_row(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    kind = rows.schema["doc_id"].dataType
    named = classes.select("set_hash", "node", "least", "rows").join(found.withColumnRenamed("component", "of"), "node", "left")
    named = materialize(named.withColumn("of", F.coalesce("of", "node")), "near-named")
    # a component's name is its smallest identifier; nodes without one are below zero and count last
    ids = materialize(named.groupBy("of").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "near-ids")
    named = join_dealt(named, ids, "of", "n", ["node"]).select("set_hash", "component_id", F.expr("node = of").alias("leads"), "rows")
    joined = join_dealt(rows.where("n_shingles > 0"), materialize(named, "near-sets"), "set_hash", "rows", ["doc_id"])
    joined = joined.select("doc_id", "n_shingles", F.col("component_id").cast(kind).alias("component_id"), "set_hash", "leads")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "set_hash", F.lit(None).cast("boolean").alias("leads"))
    return joined.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another of their component stands for; all columns as they were.

    A row without ``doc_id`` is decided by its set: it goes where a named document
    stands for its component; of a component without any, one row stays.  Rows
    without words stay.
    """
    with scratch(docs.sparkSession):
        groups = materialize(_near_groups(docs).select("doc_id", "component_id", "set_hash", "leads", "kept"), "near-rows", last=True)
    gone = unused(docs, "_ts_id")
    dropped = groups.where("doc_id is not null and not kept").select(F.col("doc_id").alias(gone)).distinct()
    named = docs.where("doc_id is not null").join(dropped.hint("merge"), docs["doc_id"] == dropped[gone], "left_anti")
    if not docs.where("doc_id is null").limit(1).count():
        return named
    return named.unionByName(_nameless_left(docs.where("doc_id is null"), groups))


def _nameless_left(nameless: DataFrame, groups: DataFrame) -> DataFrame:
    """Of rows without doc_id those that stay; groups: doc_id, component_id, set_hash, leads."""
    hashed = _hashed(nameless)
    leading = groups.where("doc_id is null and component_id is null and leads").select(F.col("set_hash").alias("_ts_hash")).distinct()
    # of equal sets the row of the smallest text, and then of the smallest other columns
    alone = hashed.join(leading, "_ts_hash", "left_semi").groupBy("_ts_hash").agg(F.min_by("row", F.struct(text_of().alias("text"), F.to_json("row").alias("all"))).alias("row"))
    return hashed.where("_ts_hash is null").select("row.*").unionByName(alone.select("row.*"))
