"""Rasters: base, halving, pyramids, box means, level sizes, tiles, orientations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from ..sources import fixtures as X
from .fixtures_sql import DIM, GRID, HAVE, PX

CH = R.RGBA
TILE = 16


def _sums(op: str) -> str:
    return ", ".join(op.format(c=c) for c in CH)


_HALVE = """halved AS (
  SELECT image, x // 2 AS x, y // 2 AS y, {parts}
  FROM (SELECT px.*, CASE WHEN x = w - 1 AND w % 2 = 1 THEN 2 ELSE 1 END * CASE WHEN y = h - 1 AND h % 2 = 1 THEN 2 ELSE 1 END AS k FROM px JOIN dim USING (image))
  GROUP BY ALL)""".format(parts=_sums("((sum({c} * k) + 2) // 4)::INT AS {c}"))


def _level(k: int) -> str:
    """Level k of the pyramid from level k - 1, as common table expressions."""
    return f"""d{k} AS (SELECT image, (w + 1) // 2 AS w, (h + 1) // 2 AS h FROM d{k - 1}),
l{k} AS (SELECT image, x // 2 AS x, y // 2 AS y, {_sums("((sum({c} * k) + 2) // 4)::INT AS {c}")}
  FROM (SELECT p.*, CASE WHEN x = w - 1 AND w % 2 = 1 THEN 2 ELSE 1 END * CASE WHEN y = h - 1 AND h % 2 = 1 THEN 2 ELSE 1 END AS k
        FROM l{k - 1} p JOIN d{k - 1} USING (image)) GROUP BY ALL)"""


_LEVELS = 4
_PYRAMID = f"WITH {PX}, {DIM}, d0 AS (SELECT * FROM dim), l0 AS (SELECT image, x, y, r, g, b, a FROM px), " + ", ".join(_level(k) for k in range(1, _LEVELS))
_ALL_LEVELS = " UNION ALL ".join(f"SELECT image, x, y, r, g, b, a, {k} AS level FROM l{k}" for k in range(_LEVELS))
_SIZES = f"""sizes AS (
  SELECT image, k::INT AS level, (w + (1 << k) - 1) // (1 << k) AS w, (h + (1 << k) - 1) // (1 << k) AS h FROM dim, range(20) t(k)
  WHERE k = 0 OR greatest((w + (1 << (k - 1)) - 1) // (1 << (k - 1)), (h + (1 << (k - 1)) - 1) // (1 << (k - 1))) > {TILE})"""


def px_base(spark, sf):
    return X.pixels(spark, sf)


def halve(spark, sf):
    px = X.pixels(spark, sf)
    return R.halve(px, R.dims(px))


def halve_weights_edge(spark, sf):
    grid = X.grid(spark, sf)
    return R.halve(grid, R.dims(grid), ["v"])


def pyramid(spark, sf):
    return R.pyramid(X.pixels(spark, sf), _LEVELS)


def pyramid_bytes(spark, sf):
    size = R.dims(X.pixels(spark, sf))
    levels = R.level_sizes(size, TILE)
    return levels.groupBy("image").agg(F.sum(F.col("w").cast("long") * F.col("h") * 4).alias("bytes"), F.count(F.lit(1)).alias("levels"))


def _box(factor):
    return lambda spark, sf: R.box_shrink(X.pixels(spark, sf), factor)


def _box_sql(f):
    return f"WITH {PX} SELECT image, x // {f} AS x, y // {f} AS y, {_sums('((sum({c}) + count(*) // 2) // count(*))::INT AS {c}')} FROM px GROUP BY ALL"


def level_sizes(spark, sf):
    return R.level_sizes(R.dims(X.pixels(spark, sf)), TILE)


def cut_tiles(spark, sf):
    return R.tile_stats(X.pixels(spark, sf), TILE)


_TILES = """SELECT image, x // 16 AS "column", y // 16 AS "row", (max(x) - min(x) + 1)::INT AS width, (max(y) - min(y) + 1)::INT AS height, count(*) AS pixels,
  sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, sum(a)::BIGINT AS sum_a,
  count(DISTINCT a::BIGINT * 16777216 + r * 65536 + g * 256 + b) AS colours FROM {t} GROUP BY ALL"""


def flagship_tiles(spark, sf):
    """Halve, cut into tiles, describe them: source, dense array, group-by, tile key, aggregate."""
    px = X.pixels(spark, sf)
    return R.tile_stats(R.halve(px, R.dims(px)), TILE)


def trimmed(spark, sf):
    px = X.pixels(spark, sf)
    sizes = R.level_sizes(R.dims(px), TILE)
    return R.trimmed(R.pyramid(px, _LEVELS), sizes, 32, 32)


#: Where orientation o shows the pixel (x, y) of a w x h image, as EXIF defines the eight.
_EXIF = {
    1: ("x", "y"), 2: ("w - 1 - x", "y"), 3: ("w - 1 - x", "h - 1 - y"), 4: ("x", "h - 1 - y"),
    5: ("y", "x"), 6: ("h - 1 - y", "x"), 7: ("h - 1 - y", "w - 1 - x"), 8: ("y", "w - 1 - x"),
}


def _orient(o):
    def query(spark, sf):
        px = X.pixels(spark, sf)
        return R.orient(px, R.dims(px), o)

    return query


def _orient_sql(o):
    x, y = _EXIF[o]
    return f"WITH {PX}, {DIM} SELECT image, ({x})::INT AS x, ({y})::INT AS y, r, g, b, a FROM px JOIN dim USING (image)"


def orient_roundtrip(spark, sf):
    """Turned and turned back by the inverse: the pixels as they were, for all eight at once."""
    px = X.pixels(spark, sf)
    size = R.dims(px)
    out = None
    for o in range(1, 9):
        turned = R.orient(px, size, o)
        back = R.orient(turned, R.dims(turned), R.inverse(o)).withColumn("o", F.lit(o))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("o").agg(F.sum(F.xxhash64("image", "x", "y", "r", "g", "b", "a").cast("decimal(38,0)")).alias("sum")).agg(F.countDistinct("sum").alias("outcomes"))


def orient_compose_table(spark, sf):
    rows = [(a, b, R.compose(a, b), R.inverse(a)) for a in range(1, 9) for b in range(1, 9)]
    return spark.createDataFrame(rows, "o_outer int, o_inner int, composed int, o_inverse int")


_D4 = """WITH m(o, a, b, c, d) AS (VALUES (1, 1, 0, 0, 1), (2, -1, 0, 0, 1), (3, -1, 0, 0, -1), (4, 1, 0, 0, -1), (5, 0, 1, 1, 0), (6, 0, -1, 1, 0), (7, 0, -1, -1, 0), (8, 0, 1, -1, 0)),
p AS (SELECT p.o AS o1, q.o AS o2, p.a * q.a + p.b * q.c AS a, p.a * q.b + p.b * q.d AS b, p.c * q.a + p.d * q.c AS c, p.c * q.b + p.d * q.d AS d FROM m p, m q),
t AS (SELECT o1, o2, m.o AS composed FROM p JOIN m USING (a, b, c, d))
SELECT o1::INT AS o_outer, o2::INT AS o_inner, composed::INT AS composed, (SELECT i.o1 FROM t i WHERE i.o2 = t.o1 AND i.composed = 1)::INT AS o_inverse FROM t"""


def oriented_rect(spark, sf):
    views = X.views(spark, sf).select("view", *[(F.col(c) / 4096.0).alias(n) for c, n in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))])
    out = None
    for o in range(1, 9):
        part = R.orient_rect(views.withColumn("o", F.lit(o)), o)
        out = part if out is None else out.unionByName(part)
    return out


_RECT_SQL = """WITH views AS (SELECT o_orderkey AS view, (o_orderkey * 37 % 3600) / 4096.0::DOUBLE AS x, (o_custkey * 53 % 2700) / 4096.0::DOUBLE AS y,
  (o_orderkey % 900 + 100) / 4096.0::DOUBLE AS w, (o_custkey % 700 + 50) / 4096.0::DOUBLE AS h FROM orders)
SELECT view, o::INT AS o,
  CASE WHEN o IN (1, 4) THEN x WHEN o IN (2, 3) THEN 1 - (x + w) WHEN o IN (5, 8) THEN y ELSE 1 - (y + h) END AS x,
  CASE WHEN o IN (1, 2) THEN y WHEN o IN (3, 4) THEN 1 - (y + h) WHEN o IN (5, 6) THEN x ELSE 1 - (x + w) END AS y,
  CASE WHEN o < 5 THEN w ELSE h END AS width, CASE WHEN o < 5 THEN h ELSE w END AS height FROM views, range(1, 9) t(o)"""


def id_pack(spark, sf):
    have = X.resident(spark, sf)
    keyed = have.withColumn("key", R.pack_id(F.col("level"), F.col("row"), F.col("column")))
    level, row, column = R.unpack_id(F.col("key"))
    return keyed.select("key", level.alias("level"), row.alias("tile_row"), column.alias("tile_column"))


def resample(spark, sf):
    grid = X.grid(spark, sf)
    return R.resample(grid, R.dims(grid), 1.5, ["v"])


_RESAMPLE_SQL = f"""WITH {GRID}, o AS (
  SELECT i % 91 AS x, i // 91 AS y FROM range(91 * 55) t(i)
), p AS (
  SELECT x, y, floor((x + 0.5) / 1.5::DOUBLE - 0.5) AS bx, floor((y + 0.5) / 1.5::DOUBLE - 0.5) AS cy, (x + 0.5) / 1.5::DOUBLE - 0.5 AS px, (y + 0.5) / 1.5::DOUBLE - 0.5 AS py FROM o
), q AS (
  SELECT x, y, bx, cy, least(1.0, greatest(0.0, (px - bx - 0.5) * 1.5 + 0.5))::DOUBLE AS fx, least(1.0, greatest(0.0, (py - cy - 0.5) * 1.5 + 0.5))::DOUBLE AS fy FROM p
)
SELECT 0 AS image, q.x::INT AS x, q.y::INT AS y, round((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy, 6) AS v FROM q
JOIN grid a ON a.x = greatest(bx, 0) AND a.y = greatest(cy, 0) JOIN grid b ON b.x = least(bx + 1, 60) AND b.y = greatest(cy, 0)
JOIN grid c ON c.x = greatest(bx, 0) AND c.y = least(cy + 1, 36) JOIN grid d ON d.x = least(bx + 1, 60) AND d.y = least(cy + 1, 36)"""

QUERIES = {
    "flagship_tiles": (flagship_tiles, f"WITH {PX}, {DIM}, {_HALVE} {_TILES.format(t='halved')}"),
    "px_base": (px_base, f"WITH {PX} SELECT * FROM px"),
    "halve": (halve, f"WITH {PX}, {DIM}, {_HALVE} SELECT * FROM halved"),
    "halve_weights_edge": (
        halve_weights_edge,
        f"""WITH {GRID}, e AS (SELECT x, y, v FROM grid UNION ALL SELECT 61, y, v FROM grid WHERE x = 60 UNION ALL SELECT x, 37, v FROM grid WHERE y = 36
          UNION ALL SELECT 61, 37, v FROM grid WHERE x = 60 AND y = 36)
        SELECT 0 AS image, (x // 2)::INT AS x, (y // 2)::INT AS y, ((sum(v) + 2) // 4)::INT AS v FROM e GROUP BY ALL""",
    ),
    "pyramid": (pyramid, f"{_PYRAMID} {_ALL_LEVELS}"),
    "pyramid_bytes": (pyramid_bytes, f"WITH {PX}, {DIM}, {_SIZES} SELECT image, sum(w * h * 4)::BIGINT AS bytes, count(*) AS levels FROM sizes GROUP BY image"),
    **{f"box_shrink_{f}": (_box(f), _box_sql(f)) for f in (2, 3, 7)},
    "level_sizes": (
        level_sizes,
        f'WITH {PX}, {DIM}, {_SIZES} SELECT image, level, w::INT AS w, h::INT AS h, ceil(w / {TILE})::INT AS columns, ceil(h / {TILE})::INT AS "rows" FROM sizes',
    ),
    "cut_tiles": (cut_tiles, f"WITH {PX} {_TILES.format(t='px')}"),
    "trimmed": (
        trimmed,
        f"""{_PYRAMID}, {_SIZES}, f AS (SELECT image, coalesce(min(CASE WHEN w <= 32 AND h <= 32 THEN level END), max(level)) AS first FROM sizes GROUP BY image)
        SELECT t.* FROM ({_ALL_LEVELS}) t JOIN f USING (image) WHERE t.level >= f.first""",
    ),
    **{f"orient_{o}": (_orient(o), _orient_sql(o)) for o in range(1, 9)},
    "orient_roundtrip": (orient_roundtrip, "SELECT 1::BIGINT AS outcomes"),
    "orient_compose_table": (orient_compose_table, _D4),
    "oriented_rect": (oriented_rect, _RECT_SQL),
    "id_pack": (
        id_pack,
        f"""WITH {HAVE} SELECT level::BIGINT * 281474976710656 + "row" * 16777216 + "column" AS key, level, "row" AS tile_row, "column" AS tile_column FROM have""",
    ),
    "resample": (resample, _RESAMPLE_SQL),
}
