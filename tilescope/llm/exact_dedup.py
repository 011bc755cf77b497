"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every row belongs to one of ``n_runs`` runs.  A run keeps, for each digest, its
best row.  Runs then meet in binomial rounds: in round k the eight runs that share
``run >> 3k`` are exchanged by (run, digest), sorted, and merged by a sort aggregate,
which retains the best identifier of each digest, so a digest that a third of all
rows share contributes at most eight rows to a merge.  The tree's root is split by digest, never one task.
Decisions travel down the same tree, keyed by (run, digest), so that the rows of
a hot digest stay dealt over all runs.

A merge trusts no digest alone: rows are merged only if SHA-256, a second 64-bit
hash and the length of the normalised text all agree.

Defined results: a null text counts as empty; all empty or blank texts are one
group; of rows that agree in length and ``doc_id`` (repeated rows) exactly one
stays; a null ``doc_id`` stays only where its group has no other candidate of
its length; texts of any length are hashed whole; an empty table gives an empty
result; other columns, whatever their names, are not read by ``exact_groups`` and come
through ``drop_exact`` as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, text_of, unused

#: What the comparison ignores: space and the characters 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
FAN_BITS = 3
KEY = ["digest", "check", "norm_len"]


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def run_count(df: DataFrame) -> int:
    """A power of two, at least 64 and at least the number of shuffle partitions."""
    return 1 << max(6, (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def digest_runs(docs: DataFrame, n_runs: int) -> DataFrame:
    """Level 0: one slim row for each row, with its rank in its run."""
    text = text_of()
    norm = normalised(text)
    rows = docs.select("doc_id", F.length(text).alias("n_chars"), norm.alias("norm")).select(
        "doc_id",
        "n_chars",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.length("norm").alias("norm_len"),
        F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(n_runs)).cast("int").alias("run"),
    )
    by_key = Window.partitionBy("run", *KEY)
    best_first = by_key.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best_first)).withColumn("in_run", F.count(F.lit(1)).over(by_key))


def merge_tree(heads: DataFrame, n_runs: int) -> DataFrame:
    """From a row for each (run, digest) to a row for each digest: its best row and size."""
    best = F.struct((-F.col("n_chars")).alias("less"), F.isnull("doc_id").alias("no_id"), "doc_id", F.col("run").alias("from_run"))
    level = heads.select("run", *KEY, best.alias("best"), F.col("in_run").alias("size"))
    left = n_runs
    while left > 1:
        level = (
            level.withColumn("run", F.shiftright("run", FAN_BITS))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
        left = (left + (1 << FAN_BITS) - 1) >> FAN_BITS
    return level.drop("run")


def exact_groups(docs: DataFrame, n_runs: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    with scratch(docs.sparkSession):
        return materialize(_exact_groups(docs, n_runs or run_count(docs)), "exact-groups", last=True)


def _exact_groups(docs: DataFrame, n_runs: int) -> DataFrame:
    level0 = materialize(digest_runs(docs, n_runs), "digest-runs")
    heads = level0.where("rank = 1")
    root = merge_tree(heads, n_runs)
    decided = heads.select("run", *KEY).join(root, KEY)
    return level0.join(decided, ["run", *KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("rank") == 1) & (F.col("run") == F.col("best.from_run"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that do not stay; all columns as they were."""
    fresh = {c: unused(docs, f"_ts_{c}") for c in ("digest", "chars", "rank", "id", "sha")}
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias(fresh["id"]), F.unhex("text_sha256").alias(fresh["sha"]))
    names = docs.columns
    rows = docs.withColumn(fresh["digest"], F.unhex(F.sha2(normalised(text_of()), 256))).withColumn(fresh["chars"], F.length(text_of()))
    joined = rows.join(kept, rows["doc_id"].eqNullSafe(kept[fresh["id"]]) & (rows[fresh["digest"]] == kept[fresh["sha"]]))
    first = Window.partitionBy(fresh["id"], fresh["sha"]).orderBy(F.desc(fresh["chars"]))
    return joined.withColumn(fresh["rank"], F.row_number().over(first)).where(F.col(fresh["rank"]) == 1).select(*[F.col(f"`{c}`") for c in names])
