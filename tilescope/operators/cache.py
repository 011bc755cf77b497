"""Budgeted caches: make room, candidates, classes of files, victims, admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 100 << 30
SPARE = 1 << 30


def make_room(files: DataFrame, wanted: int, cap: int, room: int, spare: int = SPARE) -> DataFrame:
    """files: folder, file, mtime, bytes.  Adds ``deleted``: oldest first, until what is left plus
    ``wanted`` is within ``cap`` and the room plus what was freed is ``wanted`` plus ``spare``."""
    order = Window.partitionBy("folder").orderBy("mtime", "file")
    freed = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("bytes").over(Window.partitionBy("folder"))
    enough = (total - freed + wanted <= cap) & (freed + room >= wanted + spare)
    return files.withColumn("deleted", ~enough)


def classify_name(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^[0-9a-f]{16}\.tiles$"), "finished").when(name.rlike(r"^[0-9a-f]{16}\.tiles\.part$"), "unfinished").otherwise("foreign")
    )


def best_candidate(wanted: DataFrame, stored: DataFrame, hdr: bool) -> DataFrame:
    """wanted: identity, exact (name).  stored: identity, name, place (order of folders), pq.

    The exact name in any folder; on an HDR display then any other PQ cache of the identity, then the SDR one.
    Adds ``stale`` for a hit that is not exact.
    """
    joined = wanted.join(stored, "identity")
    turn = F.when(F.col("name") == F.col("exact"), 0)
    turn = turn.when(F.lit(hdr) & F.col("pq"), 1).when(F.lit(hdr) & ~F.col("pq"), 2)
    order = Window.partitionBy("identity").orderBy("turn", "place", "name")
    ranked = joined.withColumn("turn", turn).where("turn is not null").withColumn("at", F.row_number().over(order))
    return ranked.where("at = 1").select("identity", "name", "place", (F.col("turn") > 0).alias("stale"))


def outside_evict(entries: DataFrame, ahead: int, behind: int) -> DataFrame:
    """entries: session, idx, rank, used.  Of entries outside the window all but the ``ahead - behind`` most recently wanted."""
    spare = ahead - min(ahead, behind)
    out = entries.where(F.col("rank") >= (1 << 20))
    order = Window.partitionBy("session").orderBy(F.col("used").desc(), "idx")
    return out.withColumn("at", F.row_number().over(order)).where(F.col("at") > spare).drop("at")


def victim(entries: DataFrame) -> DataFrame:
    """The farthest entry, ties least recently used; never the current one or its neighbour."""
    order = F.struct(F.col("rank").alias("rank"), (-F.col("used")).alias("older"), (-F.col("idx")).alias("i"))
    best = entries.where("rank > 1 and bytes > 0").groupBy("session").agg(F.max(order).alias("b"))
    return best.select("session", (-F.col("b.i")).alias("idx"), F.col("b.rank").alias("rank"))


def admit(jobs: DataFrame, budget: int) -> DataFrame:
    """jobs: session, turn, estimate, current.  Adds ``go``: while what went before and the job itself fit; the current one always."""
    before = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.sum("estimate").over(before), F.lit(0))
    return jobs.withColumn("go", F.col("current") | (asked + F.col("estimate") <= budget))


def trim(entries: DataFrame, budget: int, spare: int) -> DataFrame:
    """entries: session, idx, rank, used, preview, whole, frames (bytes of each).  What a cache keeps, in this order:
    drop entries outside the window beyond ``spare``; cut whole images and drop animations that are not near;
    while over budget evict the farthest; then drop animations, then whole images, of all but the current.

    Each rule takes entries in an order until enough is freed: a running sum over what went before.
    """
    session = Window.partitionBy("session")
    before = lambda *order: session.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    far = F.col("rank") >= (1 << 20)
    place = F.row_number().over(Window.partitionBy("session", far).orderBy(F.desc("used"), "idx"))
    kept = entries.withColumn("_place", place).where(~far | (F.col("_place") <= spare)).drop("_place")
    near = lambda c: F.when(F.col("rank") > 1, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
    kept = kept.select("session", "idx", "rank", "used", "preview", near("whole"), near("frames"))
    kept = kept.withColumn("_size", F.expr("preview + whole + frames")).withColumn("_total", F.sum("_size").over(session))
    able = F.when((F.col("rank") > 1) & (F.col("_size") > 0), F.col("_size")).otherwise(0)
    farthest = before(F.desc("rank"), "used", "idx")
    kept = kept.withColumn("_able", able).withColumn("_freed", run("_able", farthest))
    kept = kept.where(~((F.col("_able") > 0) & (F.col("_total") - F.col("_freed") > budget)))
    for part in ("frames", "whole"):
        kept = kept.withColumn("_total", F.sum(F.expr("preview + whole + frames")).over(session))
        kept = kept.withColumn("_able", F.when(F.col("rank") > 0, F.col(part)).otherwise(0)).withColumn("_freed", run("_able", before("idx")))
        cut = (F.col("rank") > 0) & (F.col("_total") - F.col("_freed") > budget)
        kept = kept.withColumn(part, F.when(cut, F.lit(0).cast("long")).otherwise(F.col(part)))
    return kept.select(*entries.columns)


def spaced_checkpoints(offsets: DataFrame, spacing: int) -> DataFrame:
    """offsets: file, seq, at.  The points at least ``spacing`` after the last one kept; the first is kept.

    Each choice resets the distance, so a file is read in order; only the last kept point is state.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, int] = {}
        for rows in batches:
            keep = []
            for file, at in zip(rows["file"], rows["at"], strict=True):
                ok = file not in last or at - last[file] >= spacing
                if ok:
                    last = {file: at}
                keep.append(ok)
            yield rows[keep]

    return offsets.repartition("file").sortWithinPartitions("file", "seq").mapInPandas(walk, offsets.schema)
