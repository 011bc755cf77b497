"""Lookups and decisions that stand between a request and its tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def last_at_or_before(points: DataFrame, asked: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """asked: key, at, id.  Adds ``found``: the value of the key's last point at or before: an as-of join.

    Points and questions are put in one order per key and the last point is carried on, so
    no pair of them is ever built; a point at the same place comes first.
    """
    both = points.select(key, at, F.lit(None).cast("long").alias("id"), F.col(value).alias("_v"), F.lit(0).alias("_side")).unionByName(
        asked.select(key, at, F.col("id").cast("long").alias("id"), F.lit(None).cast(points.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    )
    order = Window.partitionBy(key).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("_v", ignorenulls=True).over(order)).where("_side = 1").select(key, at, "id", "found")


def cache_folder(candidates: list[tuple[Column, Column]]) -> Column:
    """(folder, usable): the first usable one."""
    return F.coalesce(*[F.when(usable, folder) for folder, usable in candidates])


def identity_blocks(size: Column, ends: int = 65536, blocks: int = 32, block: int = 4096) -> Column:
    """(at, length) of what an identity reads of a file: all of a small one, else both ends and evenly spaced blocks."""
    between = size - 2 * ends - block
    span = lambda at, n: F.struct(at.cast("long").alias("at"), n.cast("long").alias("length"))
    middle = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: span(ends + F.floor(between * i / (blocks - 1)), F.lit(block)))
    many = F.concat(F.array(span(F.lit(0), F.lit(ends))), middle, F.array(span(size - ends, F.lit(ends))))
    return F.when(size <= 2 * ends + blocks * block, F.array(span(F.lit(0), size))).otherwise(many)


def decode_plan(kind: Column, w: Column, h: Column, whole: Column, over: Column, budget: int, screen: tuple[int, int], most: int) -> Column:
    """How a file is decoded: the box it is scaled to, whether by force, whether it is then whole, and an estimate of its bytes.

    whole: the full image is wanted; over: it does not fit the budget as it is.
    """
    scalable, cheap = kind.isin("Svg", "Pdf"), kind.isin("Jpeg", "Svg", "Pdf")
    native_bytes = w.cast("long") * h * 4
    native = over & kind.isin("WebP", "Jxl") & (native_bytes <= budget)
    preview = ~scalable & ~whole & cheap
    force = ~scalable & ~preview & over & ~native
    box = {"filled": G.filled(w, h, *screen), "fitted": G.fitted(w, h, *screen), "capped": G.capped(w, h, most)}
    side = lambda k: F.when(scalable, box["filled"][k]).when(preview, box["fitted"][k]).otherwise(box["capped"][k])
    size = lambda k: F.when(~preview & ~scalable, box["capped"][k]).otherwise(side(k))
    estimate = G.pyramid_bytes(size(0), size(1)) + F.when(~preview & native, native_bytes).otherwise(0)
    way = F.when(scalable, "filled").when(preview, "preview").when(native, "native").when(over, "forced").otherwise("capped")
    return F.struct(way.alias("way"), side(0).alias("box_w"), side(1).alias("box_h"), force.alias("force"), (~preview).alias("whole"), estimate.alias("estimate"))


def finest_source(kind: Column, small: Column, kept: Column, opens: Column) -> Column:
    """Where a tile cache reads its finest level from: rows of a TIFF, HEIF, PNG or JPEG file, or a scan from its start; null if it is stored.

    opens: the file has rows that can be read alone.  A PNG is read so only in small mode or where its points are kept.
    """
    rows = F.when(kind == "Tiff", "strips").when(kind == "Heif", "grid").when((kind == "Png") & (small | kept), "points").when(kind == "Jpeg", "restarts")
    return F.when(opens, rows)


def steps_of_rows(ranges: DataFrame) -> DataFrame:
    """ranges: id, top, count, height, step_rows, margin, steps.  The steps of a JPEG that a range of rows needs, with whether it shows them.

    Where colours are coarser than light, a step either side is decoded with it and thrown away.
    """
    bottom = F.least(F.col("top") + F.col("count"), F.col("height"))
    first, last = F.floor(F.col("top") / F.col("step_rows")), F.ceil(bottom / F.col("step_rows")) - 1
    spans = ranges.where((F.col("top") >= 0) & (F.col("top") % 8 == 0) & (bottom > F.col("top"))).withColumns({"_f": first, "_l": last})
    near = F.sequence(F.greatest(F.col("_f") - F.col("margin"), F.lit(0)), F.least(F.col("_l") + F.col("margin"), F.col("steps") - 1))
    return spans.withColumn("step", F.explode(near)).select("id", "step", F.col("step").between(F.col("_f"), F.col("_l")).alias("shown"))


def cells_of_rows(ranges: DataFrame) -> DataFrame:
    """ranges: id, top, count, height, columns, tile_height.  The cells of a grid image that a range of rows needs: row, column."""
    last = F.least(F.col("top") + F.col("count"), F.col("height")) - 1
    spans = ranges.where((F.col("top") >= 0) & (last >= F.col("top")))
    rows = spans.withColumn("row", F.explode(F.sequence(F.floor(F.col("top") / F.col("tile_height")), F.floor(last / F.col("tile_height")))))
    return rows.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).select("id", "row", "column")


def bands(images: DataFrame, rows: int) -> DataFrame:
    """images: image, h.  The bands of ``rows`` rows that a scan hands on, the last one shorter: image, band, y, rows."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("h") - 1) / rows)))
    cut = images.where("h > 0").withColumn("band", start)
    return cut.select("image", "band", (F.col("band") * rows).alias("y"), F.least(F.lit(rows), F.col("h") - F.col("band") * rows).cast("int").alias("rows"))


#: Bytes a pixel that a JPEG XL decoder holds, and the bands it runs ahead.
LOSSY_BYTES, LOSSLESS_BYTES, BANDS_AHEAD = 2.8, 1.0, 4


def scan_bytes(kind: Column, w: Column, h: Column, own_profile: Column, rows: int) -> Column:
    """Memory of a scan: a decoder of JPEG XL holds much of the image and some bands, others nothing that grows with it."""
    held = w.cast("double") * h * F.when(own_profile, F.lit(LOSSLESS_BYTES)).otherwise(F.lit(LOSSY_BYTES))
    return F.when(kind == "Jxl", F.floor(held + w.cast("double") * rows * 4 * (BANDS_AHEAD + 1)).cast("long")).otherwise(F.lit(0).cast("long"))


def same_size_sheets(levels: DataFrame, sheets: DataFrame) -> DataFrame:
    """Sheets that can be used again for a level of the same sides: an equi-join; each level takes the first."""
    pairs = levels.join(sheets, ["w", "h"])
    first = Window.partitionBy("level_id").orderBy("sheet_id")
    return pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def farthest_running(jobs: DataFrame, workers: int) -> DataFrame:
    """jobs: session, idx, rank.  Where all workers are busy, the job to abort: the farthest, the later file on ties."""
    best = jobs.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("rank", "idx")).alias("b"))
    return best.where(F.col("n") >= workers).select("session", "b.idx", "b.rank")


def settled(jobs: DataFrame) -> DataFrame:
    """session, settled: whether none of its jobs is pending."""
    return jobs.groupBy("session").agg(F.every(~F.col("pending")).alias("settled"))


def progress(bands: DataFrame) -> DataFrame:
    """bands: image, y, rows, height.  Adds the fraction done after each band."""
    return bands.withColumn("done", (F.col("y") + F.col("rows")) / F.col("height"))


def memory_shortage(wanted: Column, free: Column) -> Column:
    """The message where there is not enough memory, else null."""
    mb = lambda c: F.floor(c / 1_000_000).cast("long")
    return F.when(wanted > free, F.format_string("needs %d MB, %d MB free", mb(wanted), mb(free)))


def replaced_display(results: DataFrame, displays: DataFrame) -> DataFrame:
    """Results decoded for the display that is still shown, and those that do not depend on one."""
    now = displays.groupBy("session").agg(F.max_by("display", "seq").alias("now"))
    return results.join(now, "session").where((~F.col("hdr")) | (F.col("display") == F.col("now"))).drop("now")


def opaque_images(px: DataFrame) -> DataFrame:
    """image, opaque: an alpha channel that is zero everywhere is not one."""
    return px.groupBy("image").agg((F.max("a") == 0).alias("opaque"))


def tiff_in_rows(bits: Column, samples: Column, kind: Column, planar: Column, photometric: Column, old_jpeg: Column, plain_alpha: Column) -> Column:
    """Whether rows of a TIFF can be read alone: 8-bit unsigned, interleaved, grey or RGB, any alpha a plain one."""
    grey = (photometric == "minisblack") & samples.isin(1, 2)
    colour = (photometric == "rgb") & samples.isin(3, 4)
    return (bits == 8) & (kind == "uint") & (planar == "contig") & ~old_jpeg & (grey | colour) & (~samples.isin(2, 4) | plain_alpha)


def png_in_rows(depth: Column, palette: Column, keyed: Column, hdr: Column, interlaced: Column) -> Column:
    """8 bits, or 16 without a palette, not interlaced; an HDR one with neither palette nor colour key."""
    return ~interlaced & ((depth == 8) | ((depth == 16) & ~palette)) & (~hdr | (~palette & ~keyed))


def item_properties(associations: DataFrame, properties: DataFrame) -> DataFrame:
    """associations: file, item, nth (1-based); properties: file, ordinal (1-based), kind.  Those that exist; a 0 means none."""
    return associations.where("nth > 0").join(properties.withColumnRenamed("ordinal", "nth"), ["file", "nth"])
