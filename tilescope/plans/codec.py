"""Residuals, palettes, packed words, byte edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec as C
from ..operators import raster as R
from ..sources import fixtures as X
from .fixtures_sql import DIM, PX

CH = R.RGBA
_KEYS = "image, x, y"


def _lag(source: str, names, over: str) -> str:
    return ", ".join(f"(({c} - coalesce(lag({c}) OVER {over}, 0)) % 256 + 256) % 256 AS {c}" for c in names)


def _run(names, over: str) -> str:
    return ", ".join(f"(sum({c}) OVER {over} % 256)::INT AS {c}" for c in names)


_COLUMN, _ROW = "(PARTITION BY image, x ORDER BY y)", "(PARTITION BY image, y ORDER BY x)"


def up_filter(spark, sf):
    return C.up_filter(X.pixels(spark, sf), CH)


def slope(spark, sf):
    return C.slope(X.pixels(spark, sf), CH)


def prefix(spark, sf):
    return C.prefix(X.pixels(spark, sf), CH)


def accumulate(spark, sf):
    return C.accumulate(X.pixels(spark, sf), CH)


def green_split(spark, sf):
    return C.green_split(X.pixels(spark, sf))


def green_join(spark, sf):
    return C.green_join(C.green_split(X.pixels(spark, sf)))


def planes_encode(spark, sf):
    return C.encode_planes(X.pixels(spark, sf))


def planes_roundtrip(spark, sf):
    return C.decode_planes(C.encode_planes(X.pixels(spark, sf)))


def slope_roundtrip(spark, sf):
    return C.prefix(C.slope(X.pixels(spark, sf), CH), CH)


def filter_choice(spark, sf):
    return C.filter_choice(X.pixels(spark, sf))


_SPLIT = f"s AS (SELECT {_KEYS}, (r - g + 256) % 256 AS r, g, (b - g + 256) % 256 AS b, a FROM px)"
_COST = " + ".join("CASE WHEN {p}%s > 127 THEN 256 - {p}%s ELSE {p}%s END" % (c, c, c) for c in CH)


def palette_count(spark, sf):
    return C.palette_count(X.pixels(spark, sf), 16, 100)


def palette_index(spark, sf):
    return C.palette_index(X.pixels(spark, sf), 16)


def palette_roundtrip(spark, sf):
    px = X.pixels(spark, sf)
    coded = C.with_tile(C.palette_pixels(px, 16), 16)
    back = coded.join(C.palette_index(px, 16), ["image", "column", "row", "entry"])
    part = lambda at: F.shiftright("argb", at).bitwiseAND(F.lit(255).cast("long")).cast("int")
    return back.select("image", "x", "y", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"), part(24).alias("a"))


def pq_pack(spark, sf):
    wide = X.pixels(spark, sf).select("image", "x", "y", *[(F.col(c) * 4 + F.col("x") % 4).alias(c) for c in "rgb"], (F.col("a") % 4).alias("a"))
    word = wide.select("image", "x", "y", C.pack_pq(*[F.col(c) for c in "rgba"]).alias("word"))
    return word.select("image", "x", "y", "word", *[v.alias(k) for k, v in C.unpack_pq(F.col("word")).items()])


def halve_pq(spark, sf):
    words = pq_pack(spark, sf).select("image", "x", "y", "word")
    parts = words.select("image", "x", "y", *[v.alias(k) for k, v in C.unpack_pq(F.col("word")).items()])
    half = R.halve(parts, R.dims(parts))
    return half.select("image", "x", "y", C.pack_pq(*[F.col(c) for c in "rgba"]).alias("word"))


def box_shrink_pq(spark, sf):
    words = pq_pack(spark, sf).select("image", "x", "y", "word")
    parts = words.select("image", "x", "y", *[v.alias(k) for k, v in C.unpack_pq(F.col("word")).items()])
    return R.box_shrink(parts, 3).select("image", "x", "y", C.pack_pq(*[F.col(c) for c in "rgba"]).alias("word"))


_WIDE = f"wide AS (SELECT {_KEYS}, r * 4 + x % 4 AS r, g * 4 + x % 4 AS g, b * 4 + x % 4 AS b, a % 4 AS a FROM px)"
_WORD = "(r + g::BIGINT * 1024 + b::BIGINT * 1048576 + a::BIGINT * 1073741824)::BIGINT AS word"


def splice_apply(spark, sf):
    rows = X.table(spark, sf, "customer").select("c_custkey", F.encode(F.col("c_name"), "UTF-8").alias("data"), (F.col("c_custkey") % 4).cast("int").alias("k"))
    one = lambda at, n, text: F.struct(at.alias("at"), F.lit(n).alias("length"), F.encode(F.lit(text), "UTF-8").alias("bytes"))
    edits = F.array(one(F.col("k"), 2, "<>"), one(F.col("k") + 5, 0, "new"), one(F.col("k") + 8, 1, ""))
    return rows.select("c_custkey", C.splice(F.col("data"), edits).cast("string").alias("edited"))


def residual_sizes(spark, sf):
    """The smaller of the two encodings, by an estimate of their bytes: entropy stages are left to Parquet's codecs."""
    px = X.pixels(spark, sf)
    plain = C.with_tile(px, 16).groupBy("image", "column", "row").agg((F.count(F.lit(1)) * 3).alias("planes"), F.count(F.lit(1)).alias("_n"))
    colours = C.palette_count(px, 16, 150)
    sizes = plain.join(colours, ["image", "column", "row"]).select("image", "column", "row", "planes", (F.col("colours") * 4 + F.col("_n")).alias("palette"))
    return C.smaller_encoding(sizes)


QUERIES = {
    "up_filter": (up_filter, f"WITH {PX} SELECT {_KEYS}, {_lag('px', CH, _COLUMN)} FROM px"),
    "slope": (slope, f"WITH {PX} SELECT {_KEYS}, {_lag('px', CH, _ROW)} FROM px"),
    "prefix": (prefix, f"WITH {PX} SELECT {_KEYS}, {_run(CH, _ROW)} FROM px"),
    "accumulate": (accumulate, f"WITH {PX} SELECT {_KEYS}, {_run(CH, _COLUMN)} FROM px"),
    "green_split": (green_split, f"WITH {PX}, {_SPLIT} SELECT * FROM s"),
    "green_join": (green_join, f"WITH {PX} SELECT * FROM px"),
    "planes_encode": (planes_encode, f"WITH {PX}, {_SPLIT} SELECT {_KEYS}, {_lag('s', CH, _COLUMN)} FROM s"),
    "planes_roundtrip": (planes_roundtrip, f"WITH {PX} SELECT * FROM px"),
    "slope_roundtrip": (slope_roundtrip, f"WITH {PX} SELECT * FROM px"),
    "filter_choice": (
        filter_choice,
        f"""WITH {PX}, {_SPLIT}, u AS (SELECT {_KEYS}, {_lag('s', CH, _COLUMN)} FROM s), t AS (SELECT {_KEYS}, {_lag('u', CH, _ROW)} FROM u),
        c AS (SELECT u.image, u.y, sum({_COST.format(p='u.')})::BIGINT AS plain, sum({_COST.format(p='t.')})::BIGINT AS sloped FROM u JOIN t USING (image, x, y) GROUP BY ALL)
        SELECT image, y, plain, sloped, sloped < plain AS gradient FROM c""",
    ),
    "palette_count": (
        palette_count,
        f"""WITH {PX} SELECT image, x // 16 AS "column", y // 16 AS "row", nullif(least(count(DISTINCT (r, g, b, a)), 101), 101) AS colours FROM px GROUP BY ALL""",
    ),
    "palette_index": (
        palette_index,
        f"""WITH {PX}, f AS (SELECT image, x // 16 AS "column", y // 16 AS "row", a::BIGINT * 16777216 + r * 65536 + g * 256 + b AS argb, min(y * 64 + x) AS pos FROM px GROUP BY ALL)
        SELECT image, "column", "row", argb, (row_number() OVER (PARTITION BY image, "column", "row" ORDER BY pos) - 1)::INT AS entry FROM f""",
    ),
    "palette_roundtrip": (palette_roundtrip, f"WITH {PX} SELECT * FROM px"),
    "pq_pack": (pq_pack, f"WITH {PX}, {_WIDE} SELECT {_KEYS}, {_WORD}, r, g, b, a FROM wide"),
    "halve_pq": (
        halve_pq,
        f"""WITH {PX}, {DIM}, {_WIDE}, k AS (SELECT wide.*, CASE WHEN x = w - 1 AND w % 2 = 1 THEN 2 ELSE 1 END * CASE WHEN y = h - 1 AND h % 2 = 1 THEN 2 ELSE 1 END AS k FROM wide JOIN dim USING (image)),
        m AS (SELECT image, x // 2 AS x, y // 2 AS y, {", ".join(f"((sum({c} * k) + 2) // 4)::INT AS {c}" for c in CH)} FROM k GROUP BY ALL) SELECT {_KEYS}, {_WORD} FROM m""",
    ),
    "box_shrink_pq": (
        box_shrink_pq,
        f"""WITH {PX}, {_WIDE}, m AS (SELECT image, x // 3 AS x, y // 3 AS y, {", ".join(f"((sum({c}) + count(*) // 2) // count(*))::INT AS {c}" for c in CH)} FROM wide GROUP BY ALL)
        SELECT {_KEYS}, {_WORD} FROM m""",
    ),
    "splice_apply": (
        splice_apply,
        """WITH t AS (SELECT c_custkey, c_name AS n, (c_custkey % 4)::INT AS k FROM customer)
        SELECT c_custkey, substr(n, 1, k) || '<>' || substr(n, k + 3, 3) || 'new' || substr(n, k + 6, 3) || substr(n, k + 10) AS edited FROM t""",
    ),
    "encoding_choice": (
        residual_sizes,
        f"""WITH {PX}, t AS (SELECT image, x // 16 AS "column", y // 16 AS "row", count(*) AS n, count(DISTINCT (r, g, b, a)) AS c FROM px GROUP BY ALL)
        SELECT image, "column", "row", n * 3 AS planes, CASE WHEN c <= 150 THEN c * 4 + n END AS palette, CASE WHEN c <= 150 AND c * 4 + n < n * 3 THEN 'palette' ELSE 'planes' END AS encoding FROM t""",
    ),
}
