"""Lossless residuals and palettes of tiles, byte edits, packed words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_row() -> WindowSpec:
    return Window.partitionBy("image", "y").orderBy("x")


def by_column() -> WindowSpec:
    return Window.partitionBy("image", "x").orderBy("y")


def _mod(c: Column) -> Column:
    return F.pmod(c, F.lit(256)).cast("int")


def up_filter(px: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Each byte less the one above, modulo 256; the first row stays."""
    return px.withColumns({c: _mod(F.col(c) - F.coalesce(F.lag(c).over(by_column()), F.lit(0))) for c in channels})


def accumulate(px: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Undoes ``up_filter``."""
    return px.withColumns({c: _mod(F.sum(c).over(by_column().rowsBetween(Window.unboundedPreceding, 0))) for c in channels})


def slope(px: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Each byte less the one to its left, modulo 256; the first column stays."""
    return px.withColumns({c: _mod(F.col(c) - F.coalesce(F.lag(c).over(by_row()), F.lit(0))) for c in channels})


def prefix(px: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Undoes ``slope``."""
    return px.withColumns({c: _mod(F.sum(c).over(by_row().rowsBetween(Window.unboundedPreceding, 0))) for c in channels})


def green_split(px: DataFrame) -> DataFrame:
    """Red and blue less green, modulo 256."""
    return px.withColumns({c: _mod(F.col(c) - F.col("g")) for c in ("r", "b")})


def green_join(px: DataFrame) -> DataFrame:
    return px.withColumns({c: _mod(F.col(c) + F.col("g")) for c in ("r", "b")})


def encode_planes(px: DataFrame, channels: Sequence[str] = ("r", "g", "b", "a")) -> DataFrame:
    return up_filter(green_split(px), channels)


def decode_planes(residuals: DataFrame, channels: Sequence[str] = ("r", "g", "b", "a")) -> DataFrame:
    return green_join(accumulate(residuals, channels))


def filter_choice(px: DataFrame, channels: Sequence[str] = ("r", "g", "b", "a")) -> DataFrame:
    """image, y, plain, sloped, gradient: cost of a row's residuals over all planes, and whether sloping them is strictly cheaper."""
    up = encode_planes(px, channels)
    tilted = up.withColumns({f"_{c}": _mod(F.col(c) - F.coalesce(F.lag(c).over(by_row()), F.lit(0))) for c in channels})
    cost = lambda c: F.when(F.col(c) > 127, 256 - F.col(c)).otherwise(F.col(c))
    total = lambda names: F.sum(sum((cost(c) for c in names), F.lit(0)))
    rows = tilted.groupBy("image", "y").agg(total(channels).alias("plain"), total([f"_{c}" for c in channels]).alias("sloped"))
    return rows.withColumn("gradient", F.col("sloped") < F.col("plain"))


def argb() -> Column:
    return F.col("a").cast("long") * 16777216 + F.col("r") * 65536 + F.col("g") * 256 + F.col("b")


def with_tile(px: DataFrame, tile: int) -> DataFrame:
    return px.withColumn("column", F.expr(f"int(x div {tile})")).withColumn("row", F.expr(f"int(y div {tile})"))


def palette_count(px: DataFrame, tile: int, most: int = 256) -> DataFrame:
    """image, column, row, colours (null above ``most``): whether a tile is a palette."""
    keyed = with_tile(px, tile).select("image", "column", "row", argb().alias("argb")).distinct()
    counted = keyed.groupBy("image", "column", "row").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("image", "column", "row", F.when(F.col("n") <= most, F.col("n")).alias("colours"))


def palette_index(px: DataFrame, tile: int) -> DataFrame:
    """image, column, row, argb, entry: colours of a tile by first appearance, row by row."""
    keyed = with_tile(px, tile).withColumn("pos", F.struct("y", "x"))
    first = keyed.groupBy("image", "column", "row", argb().alias("argb")).agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("image", "column", "row").orderBy("pos")
    return first.select("image", "column", "row", "argb", (F.row_number().over(order) - 1).alias("entry"))


def palette_pixels(px: DataFrame, tile: int) -> DataFrame:
    """image, x, y, entry: each pixel as the number of its colour."""
    keyed = with_tile(px, tile).withColumn("argb", argb())
    return keyed.join(palette_index(px, tile), ["image", "column", "row", "argb"]).select("image", "x", "y", "entry")


def pack_pq(r: Column, g: Column, b: Column, a: Column) -> Column:
    """10-10-10-2 bits, red lowest."""
    return r.cast("long").bitwiseOR(F.shiftleft(g.cast("long"), 10)).bitwiseOR(F.shiftleft(b.cast("long"), 20)).bitwiseOR(F.shiftleft(a.cast("long"), 30))


def unpack_pq(word: Column) -> dict[str, Column]:
    part = lambda at, bits: F.shiftright(word, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    return {"r": part(0, 10), "g": part(10, 10), "b": part(20, 10), "a": part(30, 2)}


def splice(data: Column, edits: Column) -> Column:
    """Bytes with edits applied: edits is a sorted array of (at, length, bytes), none of which overlap."""
    start = F.struct(F.unhex(F.lit("")).alias("out"), F.lit(0).alias("pos"))
    step = lambda s, e: F.struct(
        F.concat(s["out"], F.substring(data, s["pos"] + 1, e["at"] - s["pos"]), e["bytes"]).alias("out"), (e["at"] + e["length"]).alias("pos")
    )
    return F.aggregate(edits, start, step, lambda s: F.concat(s["out"], F.substring(data, s["pos"] + 1, F.octet_length(data) - s["pos"])))


def smaller_encoding(sizes: DataFrame) -> DataFrame:
    """sizes: planes, palette (null if not a palette).  Adds ``encoding``; ties go to planes."""
    return sizes.withColumn("encoding", F.when(F.col("palette") < F.col("planes"), "palette").otherwise("planes"))


def stored_channels(alpha: Column, encoding: Column) -> Column:
    """Three where a tile has no use for its alpha; a PQ word keeps it."""
    return F.when(alpha | (encoding == "pq"), 4).otherwise(3)


def expanded(px: DataFrame, colour: str, depth: int, key: tuple[int, ...] | None = None) -> DataFrame:
    """px: image, x, y, s0.. (samples of ``colour``: grey, grey_alpha, rgb or rgba, 8 or 16 bits).  r, g, b, a of 8 bits.

    Samples of 16 bits are scaled with rounding; a colour that equals the key as stored is clear, and without alpha all else is solid.
    """
    n = {"grey": 1, "grey_alpha": 2, "rgb": 3, "rgba": 4}[colour]
    narrow = lambda c: F.expr(f"int(({c} * 255 + 32895) >> 16)") if depth == 16 else F.col(c).cast("int")
    shown = [narrow("s0")] * 3 if n < 3 else [narrow(f"s{k}") for k in range(3)]
    if n in (2, 4):
        alpha = narrow(f"s{n - 1}")
    else:
        clear = F.lit(False) if key is None else F.lit(True)
        for k, v in enumerate(key or ()):
            clear = clear & (F.col(f"s{k}") == v)
        alpha = F.when(clear, 0).otherwise(255)
    return px.select("image", "x", "y", *[c.alias(name) for c, name in zip([*shown, alpha], "rgba", strict=True)])
