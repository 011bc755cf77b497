"""Uniform shuffle into shards of exact sizes by a communication matrix.

1. Rows fall into logical partitions by a seeded hash, and are counted.  There are so
   many partitions that each has about ``PARTITION_ROWS`` rows, ``PARTITIONS`` at least.
2. The driver draws, for each partition, how many of its rows go to each shard:
   a multivariate hypergeometric draw from what the shards still need, which is
   the law of those counts under a uniform permutation of all rows.
3. Within its partition every row gets a rank by a second seeded hash (the local
   permutation); ranks map to shards by the drawn counts.
4. Within its shard every row gets its slot by a third seeded hash, bucket by
   bucket (as many as keep a bucket at ``PARTITION_ROWS`` rows), so no task ever holds
   a whole shard.

Counts are drawn from the exact hypergeometric law at every size: by numpy's sampler
where it reaches (pools under 1e9), else by inversion of the law's distribution
function around its mode, whose terms follow from each other by ratios.

Shard sizes differ by at most one.  Everything follows from hashes and a seed, so
a lost task is computed again with the same outcome.  The hash of a row covers where
it stands in the table that was written for the shuffle, so that rows which are
equal in all columns do not meet in one partition.

Defined results: a null text has size 1 and the checksum of no bytes; texts of any
length are whole; repeated rows are rows like any other; null ``doc_id`` is allowed;
an empty table gives an empty result; other columns travel along in ``shuffle_rows``
whatever their names, but for ``shard`` and ``slot``, which it sets; they are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, text_of

#: The driver holds a count for each partition and shard: a number for every 125,000 rows with 8 shards.
PARTITION_ROWS = 1_000_000
PARTITIONS = 256
SLOT_BUCKETS = 64
#: Matrices of more partitions are joined, not broadcast.
BROADCAST_PARTITIONS = 65_536


def communication_matrix(counts: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of partition p; result[p, s] of them go to shard s.

    Column sums differ by at most one; which shards get one more row is drawn too.
    """
    rng = np.random.default_rng(seed)
    total = int(counts.sum())
    need = np.full(n_shards, total // n_shards, dtype=np.int64)
    need[rng.permutation(n_shards)[: total % n_shards]] += 1
    matrix = np.zeros((len(counts), n_shards), dtype=np.int64)
    for p, rows in enumerate(counts):
        left = int(rows)
        pool = int(need.sum())
        for s in range(n_shards):
            rest = pool - int(need[s])
            got = _hypergeometric(rng, int(need[s]), rest, left)
            matrix[p, s] = got
            left -= got
            pool = rest
        need -= matrix[p]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if max(good, bad, sample) < 10**9 and good + bad < 10**9:  # numpy's generator wants no more
        return int(rng.hypergeometric(good, bad, sample))
    return by_inversion(good, bad, sample, rng.random())


def by_inversion(good: int, bad: int, sample: int, uniform: float) -> int:
    """The hypergeometric count at which the distribution function reaches ``uniform``.

    Terms beyond 12 standard deviations of the mode are below the resolution of a double.
    """
    mode = (sample + 1) * (good + 1) // (good + bad + 2)
    share = good / (good + bad)
    deviation = (sample * share * (1 - share) * (1 - sample / (good + bad))) ** 0.5
    reach = int(12 * deviation) + 30
    least, most = max(0, sample - bad, mode - reach), min(good, sample, mode + reach)
    k = np.arange(least, most, dtype=np.float64)
    # log of the ratio of each term to the one before
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], steps.cumsum()])
    terms = np.exp(logs - logs.max())
    upto = terms.cumsum()
    return least + int(min(np.searchsorted(upto, uniform * upto[-1], side="right"), most - least))


def shuffle_rows(rows: DataFrame, key: list[str], n_shards: int = 8, seed: int = 7) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; ``key``: columns whose hash, with a row's place in its file, places it.

    ``rows`` is read more than once: hand in a table that was written by ``materialize``.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), "^part-([0-9]+)", 1).cast("int")
    rows = rows.withColumn("_ts_place", F.xxhash64(part, F.col("_metadata.row_index")))
    order = [F.col(f"`{c}`") for c in (*key, "_ts_place")]
    mix = lambda k: F.xxhash64(F.lit(seed * 31 + k), *order)
    total = rows.count()
    partitions = max(PARTITIONS, -(-total // PARTITION_ROWS))
    buckets = max(SLOT_BUCKETS, -(-total // (n_shards * PARTITION_ROWS)))
    placed = rows.withColumn("_ts_part", F.pmod(mix(0), F.lit(partitions)).cast("int"))
    counts = np.zeros(partitions, dtype=np.int64)
    for r in placed.groupBy("_ts_part").count().toLocalIterator():  # a row for each partition
        counts[r[0]] = r[1]
    ends = communication_matrix(counts, n_shards, seed).cumsum(axis=1)
    cuts = rows.sparkSession.createDataFrame([(p, [int(x) for x in e]) for p, e in enumerate(ends)], "_ts_part int, _ts_ends array<bigint>")
    local = Window.partitionBy("_ts_part").orderBy(mix(1), *order)
    small = lambda table: F.broadcast(table) if partitions <= BROADCAST_PARTITIONS else table
    dealt = (
        placed.withColumn("_ts_rank", F.row_number().over(local))
        .join(small(cuts), "_ts_part")  # a row for each partition
        .withColumn("shard", F.size(F.filter("_ts_ends", lambda e: e < F.col("_ts_rank"))).cast("int"))
        .drop("_ts_part", "_ts_rank", "_ts_ends")
        .withColumn("_ts_bucket", F.pmod(mix(2), F.lit(buckets)).cast("int"))
    )
    sizes = dealt.groupBy("shard", "_ts_bucket").agg(F.count(F.lit(1)).alias("_ts_n"))
    before = Window.partitionBy("shard").orderBy("_ts_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_ts_bucket", F.coalesce(F.sum("_ts_n").over(before), F.lit(0)).alias("_ts_start"))
    within = Window.partitionBy("shard", "_ts_bucket").orderBy(mix(3), *order)
    return (
        dealt.withColumn("_ts_at", F.row_number().over(within))
        .join(small(starts), ["shard", "_ts_bucket"])  # n_shards x buckets rows, about as many as there are partitions
        .withColumn("slot", F.col("_ts_start") + F.col("_ts_at") - 1)
        .drop("_ts_bucket", "_ts_at", "_ts_start", "_ts_place")
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = text_of()
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    with scratch(docs.sparkSession):
        dealt = shuffle_rows(materialize(slim, "shard-rows"), ["doc_id", "size", "text_crc32"], n_shards, seed)
        dealt = dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
        return materialize(dealt, "shard-slots", last=True)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 7) -> None:
    """Whole rows as Parquet, a folder for each shard, in slot order within each file."""
    keyed = docs.withColumn("_ts_text", F.xxhash64(text_of()))
    with scratch(docs.sparkSession):
        dealt = shuffle_rows(materialize(keyed, "shard-docs"), ["doc_id", "_ts_text"], n_shards, seed).drop("_ts_text")
        dealt.repartition("shard", F.floor(F.col("slot") / PARTITION_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
