"""Animations as timelines: delays, starts, durations, as-of seeks, advances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_frame() -> WindowSpec:
    return Window.partitionBy("image").orderBy("frame")


def frame_delay(stated: Column) -> Column:
    """Missing is 0; 10 ms or less becomes 100 ms."""
    d = F.coalesce(stated, F.lit(0))
    return F.when(d <= 10, 100).otherwise(d).cast("int")


def frame_starts(frames: DataFrame) -> DataFrame:
    """frames: image, frame, delay.  Adds ``number`` from 0, ``start``, ``duration`` and ``progress``."""
    whole = Window.partitionBy("image")
    found = frames.withColumns(
        {
            "number": F.row_number().over(by_frame()) - 1,
            "start": F.sum("delay").over(by_frame()) - F.col("delay"),
            "duration": F.sum("delay").over(whole),
            "n": F.count(F.lit(1)).over(whole),
        }
    )
    return found.withColumn("progress", F.when(F.col("duration") > 0, F.col("start") / F.col("duration")).otherwise(0.0))


def durations(frames: DataFrame) -> DataFrame:
    return frames.groupBy("image").agg(F.sum("delay").alias("duration"), F.count(F.lit(1)).alias("frames"))


def seek(starts: DataFrame, fraction: float) -> DataFrame:
    """image, target, number: the last frame that has begun by the given share of the duration."""
    target = F.floor(F.least(F.greatest(F.lit(float(fraction)), F.lit(0.0)), F.lit(1.0)) * F.col("duration")).cast("long")
    timed = starts.withColumn("target", target)
    return timed.groupBy("image", "target").agg(F.max(F.when(F.col("start") <= F.col("target"), F.col("number"))).alias("number"))


def step_frame(number: Column, by: int, n: Column) -> Column:
    """A step wraps both ways."""
    return F.pmod(number + by, n)


def frame_shrink(images: DataFrame, most: int) -> DataFrame:
    """images: image, w, h, frames.  Adds ``factor``: the smallest by which all frames fit ``most`` bytes, never past the longer side."""
    longest = F.greatest("w", "h").cast("int")
    side = lambda n, f: F.ceil(F.col(n) / f)
    fits = F.filter(F.sequence(F.lit(1), longest), lambda f: side("w", f) * side("h", f) * 4 * F.col("frames") <= most)
    return images.withColumn("factor", F.coalesce(F.array_min(fits), longest))


def animation_bytes(images: DataFrame) -> DataFrame:
    return images.groupBy("image").agg(F.sum(F.col("w").cast("long") * F.col("h") * 4).alias("bytes"))
