"""A folder as a catalog: which files belong to it, their orders, positions and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes of files that a folder shows.
SUFFIXES = (
    ".jpg .jpeg .jpe .jfif .png .webp .jxl .gif .bmp .ico .icns .tif .tiff .heic .heif .avif .svg "
    ".svgz .pdf .jp2 .j2k .jpx .exr .hdr .ppm .pgm .pbm .pnm .pfm .fits .fit .nii .v .vips"
).split()
ORDERS = ("az", "za", "newest", "oldest", "smallest")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Letters A to Z only, unlike ``lower``."""
    return F.translate(c, UPPER, LOWER)


def suffix(name: Column) -> Column:
    return ascii_lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def natural_key(name: Column) -> Column:
    """A string whose byte order is the natural order: digit runs by value, ASCII letters caseless.

    A run of digits becomes a 0, the length of its digits without leading zeros, and those digits.
    """
    runs = F.regexp_extract_all(ascii_lower(name), F.lit("([0-9]+|[^0-9])"), F.lit(1))
    digits = lambda t: F.regexp_replace(t, "^0+", "")
    as_key = lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits(t)).cast("string"), 4, "0"), digits(t))).otherwise(t)
    return F.array_join(F.transform(runs, as_key), "")


def listed(files: DataFrame, opened: str | None = None) -> DataFrame:
    """Files with a known suffix, and the opened one whatever its suffix."""
    known = suffix(F.col("name")).isin(*SUFFIXES)
    return files.where(known | (F.col("path") == opened) if opened else known)


def order_columns(order: str) -> list[Column]:
    key = natural_key(F.col("name"))
    ties = [key, F.col("path")]
    return {
        "az": ties,
        "za": [key.desc(), F.col("path").desc()],
        "newest": [F.col("mtime").desc(), *ties],
        "oldest": [F.col("mtime"), *ties],
        "smallest": [F.col("length"), *ties],
    }[order]


def arranged(files: DataFrame, order: str) -> DataFrame:
    """Adds ``idx`` from 0 within each folder, and ``count``."""
    of = Window.partitionBy("folder")
    return files.withColumn("idx", F.row_number().over(of.orderBy(*order_columns(order))) - 1).withColumn("count", F.count(F.lit(1)).over(of))


def position(files: DataFrame) -> DataFrame:
    """Adds ``position`` as [i/n]."""
    return files.withColumn("position", F.format_string("[%d/%d]", F.col("idx") + 1, F.col("count")))


def next_order(order: Column) -> Column:
    names = F.array(*map(F.lit, ORDERS))
    return F.element_at(names, (F.array_position(names, order) % len(ORDERS) + 1).cast("int"))


def wrap(idx: Column, count: Column) -> Column:
    return F.pmod(idx, count)


#: Files read ahead and behind in the direction of travel.
AHEAD, BEHIND = 6, 2


def neighbours(files: DataFrame, direction: int = 1) -> DataFrame:
    """folder, idx, rank, neighbour: ranks 1.. ahead in the direction of travel, then behind; on a ring."""
    ahead = F.when(F.col("count") > 1, F.sequence(F.lit(1), F.least(F.lit(AHEAD), (F.col("count") - 1).cast("int")))).otherwise(F.array().cast("array<int>"))
    behind = F.when(F.col("count") > AHEAD + 1, F.sequence(F.lit(1), F.least(F.lit(BEHIND), (F.col("count") - 1 - AHEAD).cast("int")))).otherwise(F.array().cast("array<int>"))
    steps = F.concat(ahead, F.transform(behind, lambda i: -i))
    spread = files.select("folder", "idx", "count", F.posexplode(steps).alias("at", "step"))
    return spread.select("folder", "idx", (F.col("at") + 1).alias("rank"), wrap(F.col("idx") + F.col("step") * direction, F.col("count")).cast("int").alias("neighbour"))


#: Rank of a file outside the window.
FAR = 1 << 20


def window_rank(idx: Column, current: Column, count: Column, direction: int = 1) -> Column:
    """0 for the current file, then ahead, then behind, else FAR."""
    off = F.pmod((idx - current) * direction, count)
    ahead = F.least(F.lit(AHEAD), count - 1)
    behind = F.greatest(F.lit(0), F.least(F.lit(BEHIND), count - 1 - AHEAD))
    back = F.pmod(-off, count)
    return F.when(off == 0, 0).when(off <= ahead, off).when(back <= behind, ahead + back).otherwise(F.lit(FAR)).cast("int")
