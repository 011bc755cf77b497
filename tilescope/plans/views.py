"""Tiles of views: visible, ordered, wanted, missing, replaced, covered, uploaded, evicted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from ..sources import fixtures as X
from .fixtures_sql import HAVE, VIEWS

TILE, COLUMNS, ROWS = 256, 16, 12
_VISIBLE = """vis AS (
  SELECT v.*, c::INT AS "column", q::INT AS "row" FROM views v, range(16) a(c), range(12) b(q)
  WHERE c >= v.x // 256 AND c <= (v.x + v.w + 255) // 256 - 1 AND q >= v.y // 256 AND q <= (v.y + v.h + 255) // 256 - 1)"""
_RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY view ORDER BY d2, "row", "column") AS place FROM (
    SELECT *, (power(2 * x + w - (2 * "column" + 1) * 256, 2) + power(2 * y + h - (2 * "row" + 1) * 256, 2))::BIGINT AS d2 FROM vis))"""
_WANTED = """wanted AS (SELECT view, 0 AS level, "column", "row" FROM vis)"""


def visible(spark, sf):
    return V.visible_tiles(X.views(spark, sf), TILE, COLUMNS, ROWS)


def _wanted(spark, sf):
    return visible(spark, sf).select("view", F.lit(0).alias("level"), "column", "row")


def visible_tiles(spark, sf):
    return visible(spark, sf)


def tiles_by_distance(spark, sf):
    return V.by_distance(visible(spark, sf), TILE).select("view", "column", "row", "d2", "place")


def want_64(spark, sf):
    ranked = V.by_distance(visible(spark, sf), TILE)
    return V.want(ranked.unionByName(ranked.withColumn("place", F.col("place") + 100)), COLUMNS, ROWS, 64)


def missing_tiles(spark, sf):
    return V.missing(_wanted(spark, sf), X.resident(spark, sf))


def fallback_level(spark, sf):
    return V.fallback(_wanted(spark, sf), X.resident(spark, sf), 3)


def coverage(spark, sf):
    return V.coverage(_wanted(spark, sf), X.resident(spark, sf))


def upload_budget(spark, sf):
    ranked = V.by_distance(visible(spark, sf), TILE)
    queue = V.want(ranked, COLUMNS, ROWS, 64).withColumn("bytes", (F.col("column") + 1) * 1000 + F.col("row"))
    return V.upload(queue, 30_000)


def missing_bytes(spark, sf):
    gone = V.missing(_wanted(spark, sf), X.resident(spark, sf))
    return gone.groupBy("view").agg(F.sum((F.col("column") + 1) * 1000 + F.col("row")).alias("bytes"))


def rect_difference(spark, sf):
    return V.rect_difference(X.views(spark, sf).withColumns({"qx": F.lit(1000), "qy": F.lit(800), "qw": F.lit(900), "qh": F.lit(700)}))


def rect_overlap(spark, sf):
    return V.overlap(X.views(spark, sf), {"x": F.lit(1000), "y": F.lit(800), "w": F.lit(900), "h": F.lit(700)})


def evict_tiles(spark, sf):
    return V.evict_oldest(X.resident(spark, sf), 500_000, "level").drop("used")


def svg_pieces(spark, sf):
    sizes = X.views(spark, sf).select(F.col("view").alias("image"), "w", "h")
    return V.pieces(sizes, 300)


def prefetch_ring(spark, sf):
    return V.prefetch_ring(X.views(spark, sf), TILE, COLUMNS, ROWS)


def strip_units(spark, sf):
    return V.units_of_range(X.views(spark, sf), 128, 2600)


def wanted_level(spark, sf):
    return V.wanted_level(X.views(spark, sf).select("view", (F.col("w") / F.lit(1000.0)).alias("zoom")), 5)


def vram_eviction(spark, sf):
    tiles = X.resident(spark, sf).select("*", (F.col("row") % 2 == 0).alias("warm"), (F.col("column") % 3 == 0).alias("stale"), F.lit(2).alias("coarsest"), (F.col("row") % 4).alias("sheet"))
    return V.vram_eviction(tiles, 2_000_000).select("sheet", "level", "column", "row", "turn", "freed_before")


_BANDS = """SELECT view, band, bx::INT AS bx, "by"::INT AS "by", bw::INT AS bw, bh::INT AS bh FROM (
  SELECT view, 'above' AS band, x AS bx, y AS "by", w AS bw, iy0 - y AS bh FROM i WHERE meets UNION ALL
  SELECT view, 'below', x, iy1, w, y + h - iy1 FROM i WHERE meets UNION ALL
  SELECT view, 'left', x, iy0, ix0 - x, iy1 - iy0 FROM i WHERE meets UNION ALL
  SELECT view, 'right', ix1, iy0, x + w - ix1, iy1 - iy0 FROM i WHERE meets UNION ALL
  SELECT view, 'whole', x, y, w, h FROM i WHERE NOT meets) WHERE bw > 0 AND bh > 0"""
_OVERLAP = """i AS (SELECT *, ix0 < ix1 AND iy0 < iy1 AS meets FROM (
  SELECT *, greatest(x, 1000) AS ix0, greatest(y, 800) AS iy0, least(x + w, 1900) AS ix1, least(y + h, 1500) AS iy1 FROM views))"""

QUERIES = {
    "visible_tiles": (visible_tiles, f"WITH {VIEWS}, {_VISIBLE} SELECT * FROM vis"),
    "tiles_by_distance": (tiles_by_distance, f'WITH {VIEWS}, {_VISIBLE}, {_RANKED} SELECT view, "column", "row", d2, place::INT AS place FROM ranked'),
    "want_64": (want_64, f'WITH {VIEWS}, {_VISIBLE}, {_RANKED} SELECT view, "column", "row", place::INT AS place, place::INT AS turn FROM ranked WHERE place <= 64'),
    "missing_tiles": (
        missing_tiles,
        f'WITH {VIEWS}, {_VISIBLE}, {HAVE}, {_WANTED} SELECT w.* FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.level = 0 AND h."column" = w."column" AND h."row" = w."row")',
    ),
    "fallback_level": (
        fallback_level,
        f"""WITH {VIEWS}, {_VISIBLE}, {HAVE}, {_WANTED}
        SELECT w.view, w.level, w."column", w."row", min(h.level)::INT AS drawn FROM wanted w LEFT JOIN have h
          ON h."column" = w."column" // (1 << h.level) AND h."row" = w."row" // (1 << h.level) GROUP BY ALL""",
    ),
    "coverage": (
        coverage,
        f"""WITH {VIEWS}, {_VISIBLE}, {HAVE}, {_WANTED} SELECT w.view, count(*) AS tiles, count(h.level) AS there, count(*) = count(h.level) AS covered
        FROM wanted w LEFT JOIN have h ON h.level = 0 AND h."column" = w."column" AND h."row" = w."row" GROUP BY w.view""",
    ),
    "upload_budget": (
        upload_budget,
        f"""WITH {VIEWS}, {_VISIBLE}, {_RANKED}, u AS (
          SELECT view, "column", "row", place::INT AS place, place::INT AS turn, ("column" + 1) * 1000 + "row" AS bytes FROM ranked WHERE place <= 64)
        SELECT * FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY view ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM u) WHERE before < 30000""",
    ),
    "missing_bytes": (
        missing_bytes,
        f"""WITH {VIEWS}, {_VISIBLE}, {HAVE}, {_WANTED} SELECT view, sum((w."column" + 1) * 1000 + w."row")::BIGINT AS bytes FROM wanted w
        ANTI JOIN have h ON h.level = 0 AND h."column" = w."column" AND h."row" = w."row" GROUP BY view""",
    ),
    "rect_difference": (rect_difference, f"WITH {VIEWS}, {_OVERLAP} {_BANDS}"),
    "rect_overlap": (
        rect_overlap,
        f"""WITH {VIEWS}, {_OVERLAP} SELECT view, ix0::INT AS ix, iy0::INT AS iy, greatest(ix1 - ix0, 0)::INT AS iw, greatest(iy1 - iy0, 0)::INT AS ih,
        x >= 1000 AND y >= 800 AND x + w <= 1900 AND y + h <= 1500 AS contained FROM i""",
    ),
    "evict_tiles": (
        evict_tiles,
        f"""WITH {HAVE} SELECT level, "column", "row", bytes, freed_before FROM (
        SELECT *, coalesce(sum(bytes) OVER (PARTITION BY level ORDER BY used, "column", "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM have)
        WHERE freed_before < 500000""",
    ),
    "svg_pieces": (
        svg_pieces,
        f"""WITH {VIEWS} SELECT view AS image, i * 300 AS "left", j * 300 AS top, least(300, w - i * 300)::BIGINT AS width, least(300, h - j * 300)::BIGINT AS height
        FROM views, range(4) a(i), range(4) b(j) WHERE i * 300 < w AND j * 300 < h""",
    ),
    "prefetch_ring": (
        prefetch_ring,
        f"""WITH {VIEWS}, {_VISIBLE} SELECT v.view, c::INT AS "column", q::INT AS "row" FROM views v, range(16) a(c), range(12) b(q)
        WHERE c >= v.x // 256 - 1 AND c <= (v.x + v.w + 255) // 256 AND q >= v.y // 256 - 1 AND q <= (v.y + v.h + 255) // 256
        EXCEPT SELECT view, "column", "row" FROM vis""",
    ),
    "strip_units": (strip_units, f"WITH {VIEWS} SELECT view, u AS unit FROM views, range(21) t(u) WHERE y < 2600 AND u * 128 < y + h AND (u + 1) * 128 > y AND u * 128 < 2600"),
    "wanted_level": (
        wanted_level,
        f"""WITH {VIEWS} SELECT view, w / 1000.0::DOUBLE AS zoom, CASE WHEN w <= 62.5 THEN 4 WHEN w <= 125 THEN 3 WHEN w <= 250 THEN 2 WHEN w <= 500 THEN 1 ELSE 0 END AS level FROM views""",
    ),
    "vram_eviction": (
        vram_eviction,
        f"""WITH {HAVE}, t AS (SELECT "row" % 4 AS sheet, *, CASE WHEN "row" % 2 = 0 THEN 0 ELSE 1 END AS turn FROM have WHERE level < 2 AND ("row" % 2 = 0 OR "column" % 3 = 0))
        SELECT sheet, level, "column", "row", turn, freed_before FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY sheet ORDER BY turn, used, level, "column", "row"
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM t) WHERE freed_before < 2000000""",
    ),
}
