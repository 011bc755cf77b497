"""Tiles of a view: which are visible, wanted, missing, replaced by coarser ones, uploaded or evicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["level", "column", "row"]


def visible_tiles(views: DataFrame, tile: int, columns: int, rows: int) -> DataFrame:
    """A row for each tile that a view's rectangle touches: first at floor, last at ceil - 1, clamped to the grid.

    The range is derived from the rectangle, so no view meets a tile it doesn't show.
    """
    first = lambda at: F.greatest(F.floor(F.col(at) / tile), F.lit(0))
    last = lambda at, side, n: F.least(F.ceil((F.col(at) + F.col(side)) / tile) - 1, F.lit(n - 1))
    spans = views.withColumns({"_c0": first("x"), "_c1": last("x", "w", columns), "_r0": first("y"), "_r1": last("y", "h", rows)})
    spans = spans.where("_c0 <= _c1 and _r0 <= _r1")
    cols = spans.withColumn("column", F.explode(F.sequence("_c0", "_c1").cast("array<int>")))
    return cols.withColumn("row", F.explode(F.sequence("_r0", "_r1").cast("array<int>"))).drop("_c0", "_c1", "_r0", "_r1")


def by_distance(visible: DataFrame, tile: int) -> DataFrame:
    """Adds ``d2``, four times the squared distance of the tile's centre to the view's, and ``place`` in that order."""
    off = lambda at, side, k: 2 * F.col(at) + F.col(side) - (2 * F.col(k) + 1) * tile
    dx, dy = off("x", "w", "column"), off("y", "h", "row")
    ranked = visible.withColumn("d2", (dx * dx + dy * dy).cast("long"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("view").orderBy("d2", "row", "column")))


def want(ranked: DataFrame, columns: int, rows: int, most: int = 64) -> DataFrame:
    """The first ``most`` valid tiles of a view, each once, in order of ``place``."""
    valid = ranked.where(f"column between 0 and {columns - 1} and row between 0 and {rows - 1}")
    once = valid.groupBy("view", "column", "row").agg(F.min("place").alias("place"))
    queue = once.withColumn("turn", F.row_number().over(Window.partitionBy("view").orderBy("place")))
    return queue.where(F.col("turn") <= most)


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Wanted tiles that are not there."""
    return wanted.join(have.select(*KEY).distinct(), KEY, "left_anti")


def fallback(wanted: DataFrame, have: DataFrame, levels: int) -> DataFrame:
    """For each wanted tile the finest level, its own or coarser, that has its place; null if none.

    A wanted tile is spread over the ``levels`` places it could be drawn from and joined by
    key, so the as-of lookup is an equi-join.
    """
    steps = wanted.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    at = steps.withColumns({"_level": F.col("level") + F.col("_d"), "_column": F.expr("column >> _d"), "_row": F.expr("row >> _d")})
    there = have.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct().withColumn("_there", F.lit(True))
    found = at.join(there, [f"_{c}" for c in KEY], "left")
    return found.groupBy("view", *KEY).agg(F.min(F.when(F.col("_there"), F.col("_level"))).alias("drawn"))


def coverage(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """view, tiles, there, covered: whether all tiles of a view are there."""
    marked = wanted.join(have.select(*KEY).distinct().withColumn("_there", F.lit(1)), KEY, "left")
    return marked.groupBy("view").agg(F.count(F.lit(1)).alias("tiles"), F.count("_there").alias("there")).withColumn("covered", F.col("tiles") == F.col("there"))


def upload(queue: DataFrame, budget: int) -> DataFrame:
    """Tiles in order of ``turn`` while less than ``budget`` bytes went before: the last may overshoot."""
    order = Window.partitionBy("view").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return queue.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("before") < budget)


def evict_oldest(tiles: DataFrame, wanted: int, group: str) -> DataFrame:
    """Tiles by last use, oldest first, until at least ``wanted`` bytes are freed."""
    order = Window.partitionBy(group).orderBy("used", *[c for c in KEY if c != group]).rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("freed_before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("freed_before") < wanted)


def vram_eviction(tiles: DataFrame, wanted: int) -> DataFrame:
    """tiles: sheet, warm, level, coarsest, stale, used, bytes.  Warm fine levels go first, then stale tiles of the
    current image, oldest first; the coarsest level never goes."""
    turn = F.when(F.col("warm"), 0).when(F.col("stale"), 1)
    able = tiles.where((F.col("level") < F.col("coarsest")) & (F.col("warm") | F.col("stale"))).withColumn("turn", turn)
    order = Window.partitionBy("sheet").orderBy("turn", "used", "level", "column", "row").rowsBetween(Window.unboundedPreceding, -1)
    return able.withColumn("freed_before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("freed_before") < wanted)


def rect_difference(pairs: DataFrame) -> DataFrame:
    """pairs: x, y, w, h less qx, qy, qw, qh: up to four bands above, below, left and right of the overlap."""
    x1, y1 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ix0, iy0 = F.greatest("x", "qx"), F.greatest("y", "qy")
    ix1, iy1 = F.least(x1, F.col("qx") + F.col("qw")), F.least(y1, F.col("qy") + F.col("qh"))
    meets = (ix0 < ix1) & (iy0 < iy1)
    band = lambda name, bx, by, bw, bh: F.struct(F.lit(name).alias("band"), bx.alias("bx"), by.alias("by"), bw.alias("bw"), bh.alias("bh"))
    x, y, w, h = (F.col(c) for c in "xywh")
    parts = F.when(
        meets,
        F.array(band("above", x, y, w, iy0 - y), band("below", x, iy1, w, y1 - iy1), band("left", x, iy0, ix0 - x, iy1 - iy0), band("right", ix1, iy0, x1 - ix1, iy1 - iy0)),
    ).otherwise(F.array(band("whole", x, y, w, h)))
    return pairs.withColumn("_b", F.explode(parts)).select("view", "_b.*").where("bw > 0 and bh > 0")


def overlap(views: DataFrame, other: dict[str, Column]) -> DataFrame:
    """Intersection of each view with another rectangle: ix, iy, iw, ih (0 where they do not meet) and whether it is contained."""
    joined = views.withColumns({f"q{k}": v for k, v in other.items()})
    ix0, iy0 = F.greatest("x", "qx"), F.greatest("y", "qy")
    ix1 = F.least(F.col("x") + F.col("w"), F.col("qx") + F.col("qw"))
    iy1 = F.least(F.col("y") + F.col("h"), F.col("qy") + F.col("qh"))
    iw, ih = F.greatest(ix1 - ix0, F.lit(0)), F.greatest(iy1 - iy0, F.lit(0))
    return joined.select("view", ix0.alias("ix"), iy0.alias("iy"), iw.alias("iw"), ih.alias("ih"), ((iw == F.col("w")) & (ih == F.col("h"))).alias("contained"))


def pieces(sizes: DataFrame, piece: int) -> DataFrame:
    """sizes: image, w, h.  The grid of pieces no larger than ``piece`` a side: image, left, top, width, height."""
    starts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(piece).cast("long")))
    cut = sizes.withColumn("left", starts("w")).withColumn("top", starts("h"))
    return cut.select("image", "left", "top", F.least(F.lit(piece), F.col("w") - F.col("left")).alias("width"), F.least(F.lit(piece), F.col("h") - F.col("top")).alias("height"))


def prefetch_ring(views: DataFrame, tile: int, columns: int, rows: int) -> DataFrame:
    """Tiles that a view grown by one tile on each side touches and the view itself does not."""
    grown = views.withColumns({"x": F.col("x") - tile, "y": F.col("y") - tile, "w": F.col("w") + 2 * tile, "h": F.col("h") + 2 * tile})
    near = visible_tiles(grown, tile, columns, rows).select("view", "column", "row")
    return near.join(visible_tiles(views, tile, columns, rows).select("view", "column", "row"), ["view", "column", "row"], "left_anti")


def upload_turns(views: DataFrame, sizes: DataFrame, tile: int, budget: int) -> DataFrame:
    """views: view, level, x, y, w, h (in pixels of its level); sizes: level, columns, rows.  Tiles in the order in which a frame uploads them.

    Turns: 0 the next coarser level where the wanted tiles (4 bytes a pixel) are beyond the budget, so that no
    hole shows; 1 what is seen; 2 the ring of one tile around it; 3 the same of the next coarser level.
    """
    half = lambda c: F.floor(F.col(c) / 2)
    coarse = views.select("view", (F.col("level") + 1).alias("level"), half("x").alias("x"), half("y").alias("y"), F.ceil(F.col("w") / 2).alias("w"), F.ceil(F.col("h") / 2).alias("h"))
    ringed = lambda some: some.withColumns({"x": F.col("x") - tile, "y": F.col("y") - tile, "w": F.col("w") + 2 * tile, "h": F.col("h") + 2 * tile})

    def tiles_of(some: DataFrame) -> DataFrame:
        first = lambda at: F.greatest(F.floor(F.col(at) / tile), F.lit(0))
        last = lambda at, side, n: F.least(F.ceil((F.col(at) + F.col(side)) / tile), F.col(n)) - 1
        spans = some.join(sizes, "level").withColumns({"_c0": first("x"), "_c1": last("x", "w", "columns"), "_r0": first("y"), "_r1": last("y", "h", "rows")}).where("_c0 <= _c1 and _r0 <= _r1")
        cols = spans.withColumn("column", F.explode(F.sequence("_c0", "_c1")))
        return cols.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).select("view", *KEY)

    seen = tiles_of(views)
    crowded = seen.groupBy("view").count().where(F.col("count") * tile * tile * 4 > budget).select("view")
    parts = (tiles_of(coarse).join(crowded, "view", "left_semi"), seen, tiles_of(ringed(views)), tiles_of(ringed(coarse)))
    every = None
    for turn, part in enumerate(parts):
        part = part.withColumn("turn", F.lit(turn))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("view", *KEY).agg(F.min("turn").alias("turn"))


def keep_warm(warm: DataFrame, keep: DataFrame) -> DataFrame:
    """Of the images held warm those that are still to be kept: session, image."""
    return warm.join(keep.select("session", "image").distinct(), ["session", "image"], "left_semi")


def units_of_range(ranges: DataFrame, unit_rows: int, height: int) -> DataFrame:
    """ranges: view, y, h.  The strips of ``unit_rows`` rows that each range of rows needs."""
    last = F.least(F.floor((F.col("y") + F.col("h") - 1) / unit_rows), F.lit((height - 1) // unit_rows))
    return ranges.where(f"h > 0 and y < {height}").select("view", F.explode(F.sequence(F.floor(F.col("y") / unit_rows), last)).alias("unit"))


def wanted_level(zooms: DataFrame, levels: int) -> DataFrame:
    """zooms: view, zoom.  The coarsest level whose scale 1 / 2^k is at least the zoom, or else the finest."""
    found = F.array(*[F.when(F.lit(1.0 / (1 << k)) >= F.col("zoom"), F.lit(k)) for k in range(levels)])
    return zooms.withColumn("level", F.coalesce(F.array_max(found), F.lit(0)))
