"""Rasters in long form: a row for each pixel, keyed by (image, x, y) with channel columns.

Every operator is a projection, a group-by or a window, so images are split over
tasks by (image, block) and no task ever needs a whole image.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGBA = ("r", "g", "b", "a")


def dims(px: DataFrame) -> DataFrame:
    """image, w, h."""
    return px.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def halve(px: DataFrame, size: DataFrame, channels: Sequence[str] = RGBA) -> DataFrame:
    """Mean of 2 x 2, halves up; an odd last column or row counts twice.

    size: image, w, h (one row an image).
    """
    last = lambda at, n: F.when((F.col(at) == F.col(n) - 1) & (F.col(n) % 2 == 1), 2).otherwise(1)
    weighed = px.join(size, "image").withColumn("_k", last("x", "w") * last("y", "h"))
    sums = [F.sum(F.col(c) * F.col("_k")).alias(c) for c in channels]
    blocks = weighed.groupBy("image", F.expr("int(x div 2)").alias("x"), F.expr("int(y div 2)").alias("y")).agg(*sums)
    return blocks.select("image", "x", "y", *[F.shiftright(F.col(c) + 2, 2).cast("int").alias(c) for c in channels])


def half_size(size: DataFrame) -> DataFrame:
    return size.select("image", F.expr("int((w + 1) div 2)").alias("w"), F.expr("int((h + 1) div 2)").alias("h"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder that executors share, and read from there: its plan is not run again, its lineage is cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tilescope-"))
    return df.checkpoint()


def pyramid(px: DataFrame, levels: int, channels: Sequence[str] = RGBA) -> DataFrame:
    """Level 0 and ``levels - 1`` halvings, each of the one before (rounding differs from halving level 0 at once).

    A level that another is made of is checkpointed, so that none is made twice; the sides are made of the images' own.
    """
    size, level = checkpointed(dims(px)), px.select("image", "x", "y", *channels)
    out = level.withColumn("level", F.lit(0))
    for k in range(1, levels):
        level, size = halve(level, size, channels), half_size(size)
        if k + 1 < levels:
            level = checkpointed(level)
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def box_shrink(px: DataFrame, factor: int, channels: Sequence[str] = RGBA) -> DataFrame:
    """Mean of factor x factor, halves up; blocks at the edge count what they hold."""
    blocks = px.groupBy("image", F.expr(f"int(x div {factor})").alias("x"), F.expr(f"int(y div {factor})").alias("y"))
    sums = blocks.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in channels])
    return sums.select("image", "x", "y", *[F.expr(f"int(({c} + _n div 2) div _n)").alias(c) for c in channels])


def level_sizes(size: DataFrame, tile: int, most: int = 24) -> DataFrame:
    """image, level, w, h, columns, rows: halved, rounding up, until both sides fit a tile."""
    side = lambda n, k: F.expr(f"int((({n} - 1) div (1 << {k})) + 1)")
    levels = size.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(most))))
    found = levels.select("image", "level", side("w", "level").alias("w"), side("h", "level").alias("h"), F.greatest("w", "h").alias("_most"))
    # a level is there if the one before it does not fit a tile
    kept = found.where(F.expr(f"level = 0 or ((_most - 1) div (1 << (level - 1))) + 1 > {tile}"))
    parts = lambda n: F.expr(f"int(({n} - 1) div {tile} + 1)")
    return kept.select("image", "level", "w", "h", parts("w").alias("columns"), parts("h").alias("rows"))


def fitting_level(sizes: DataFrame, box_w: int, box_h: int) -> DataFrame:
    """image, level: the finest level within the box, or else the last."""
    fits = (F.col("w") <= box_w) & (F.col("h") <= box_h)
    return sizes.groupBy("image").agg(F.coalesce(F.min(F.when(fits, F.col("level"))), F.max("level")).alias("level"))


def trimmed(levels: DataFrame, sizes: DataFrame, box_w: int, box_h: int) -> DataFrame:
    """Rows of ``levels`` from the fitting level on."""
    first = fitting_level(sizes, box_w, box_h).withColumnRenamed("level", "_first")
    return levels.join(first, "image").where("level >= _first").drop("_first")


def tile_stats(px: DataFrame, tile: int) -> DataFrame:
    """image, column, row, width, height, pixels, sums of channels and number of distinct colours."""
    keyed = px.withColumn("column", F.expr(f"int(x div {tile})")).withColumn("row", F.expr(f"int(y div {tile})"))
    colour = F.col("a").cast("long") * 16777216 + F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    return keyed.groupBy("image", "column", "row").agg(
        (F.max("x") - F.min("x") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"),
        F.count(F.lit(1)).alias("pixels"),
        *[F.sum(c).alias(f"sum_{c}") for c in RGBA],
        F.countDistinct(colour).alias("colours"),
    )


#: Which of the orientations 1 to 8 mirror, and their clockwise quarter turns.
MIRRORS = (False, True, False, True, True, False, True, False)
QUARTERS = (0, 0, 2, 2, 3, 1, 1, 3)


def orientation(mirror: bool, quarters: int) -> int:
    return next(o for o in range(1, 9) if (MIRRORS[o - 1], QUARTERS[o - 1]) == (mirror, quarters % 4))


def compose(outer: int, inner: int) -> int:
    """The one orientation that does ``inner`` and then ``outer``; mirrors come before turns."""
    m, q, n, p = MIRRORS[outer - 1], QUARTERS[outer - 1], MIRRORS[inner - 1], QUARTERS[inner - 1]
    return orientation(m != n, q - p if m else q + p)


def inverse(o: int) -> int:
    return next(i for i in range(1, 9) if compose(i, o) == 1)


def orient(px: DataFrame, size: DataFrame, o: int) -> DataFrame:
    """Pixels moved to where orientation ``o`` shows them."""
    joined = px.join(size, "image")
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    if MIRRORS[o - 1]:
        x = w - 1 - x
    for _ in range(QUARTERS[o - 1]):
        x, y, w, h = h - 1 - y, x, h, w
    others = [c for c in px.columns if c not in ("image", "x", "y")]
    return joined.select("image", x.alias("x"), y.alias("y"), *others)


def orient_rect(rects: DataFrame, o: int) -> DataFrame:
    """rects: x, y, width, height in the unit square, other columns kept; moved as orientation ``o`` shows them."""
    x0, y0 = F.col("x"), F.col("y")
    x1, y1 = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    if MIRRORS[o - 1]:
        x0, x1 = 1 - x0, 1 - x1
    for _ in range(QUARTERS[o - 1]):
        x0, y0, x1, y1 = 1 - y0, x0, 1 - y1, x1
    others = [c for c in rects.columns if c not in ("x", "y", "width", "height")]
    return rects.select(*others, F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("width"), F.abs(y1 - y0).alias("height"))


def pack_id(level: Column, row: Column, column: Column) -> Column:
    """A tile's key as one number: level, row, column in 16, 24 and 24 bits."""
    return F.shiftleft(level.cast("long"), 48).bitwiseOR(F.shiftleft(row.cast("long"), 24)).bitwiseOR(column.cast("long"))


def unpack_id(key: Column) -> tuple[Column, Column, Column]:
    mask = F.lit(0xFFFFFF).cast("long")
    return F.shiftright(key, 48).cast("int"), F.shiftright(key, 24).bitwiseAND(mask).cast("int"), key.bitwiseAND(mask).cast("int")


def resample(px: DataFrame, size: DataFrame, scale: float, channels: Sequence[str] = ("r",)) -> DataFrame:
    """Sharp bilinear: the four nearest samples, blended over one target pixel; a fixed number of joins."""
    out = size.select(
        "image", "w", "h", F.explode(F.sequence(F.lit(0), F.floor(F.col("w") * scale).cast("int") - 1)).alias("x")
    ).withColumn("y", F.explode(F.sequence(F.lit(0), F.floor(F.col("h") * scale).cast("int") - 1)))
    def axis(at: str, n: str) -> tuple[Column, Column]:
        pos = (F.col(at) + 0.5) / scale - 0.5
        base = F.floor(pos)
        blend = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (pos - base - 0.5) * max(scale, 1.0) + 0.5))
        return base, blend
    (bx, fx), (by, fy) = axis("x", "w"), axis("y", "h")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = out.select("image", "x", "y", "w", "h", bx.alias("bx"), by.alias("by"), fx.alias("fx"), fy.alias("fy"), F.explode(corners).alias("c"))
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.col(n) - 1).cast("int")
    at = spread.select(
        "image", F.col("x").alias("ox"), F.col("y").alias("oy"),
        clamp(F.col("bx") + F.col("c.i"), "w").alias("x"), clamp(F.col("by") + F.col("c.j"), "h").alias("y"),
        (F.when(F.col("c.i") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("c.j") == 1, F.col("fy")).otherwise(1 - F.col("fy"))).alias("k"),
    )
    sums = at.join(px, ["image", "x", "y"]).groupBy("image", F.col("ox").alias("x"), F.col("oy").alias("y")).agg(*[F.round(F.sum(F.col(c) * F.col("k")), 6).alias(c) for c in channels])
    return sums

