"""As-of lookups, decisions and state predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from ..sources import fixtures as X
from .fixtures_sql import FR, PX


def checkpoint_lookup(spark, sf):
    """For each order's price the last part price of its size class at or below it."""
    points = X.table(spark, sf, "part").select(F.col("p_size").cast("long").alias("k"), F.floor("p_retailprice").cast("long").alias("at"), F.col("p_partkey").alias("v"))
    points = points.groupBy("k", "at").agg(F.max("v").alias("v"))
    asked = X.table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("k"), (F.floor("o_totalprice").cast("long") % 2500).alias("at"), F.col("o_orderkey").alias("id"))
    return L.last_at_or_before(points, asked, "k", "at", "v")


def cache_folder(spark, sf):
    k = F.col("o_orderkey")
    folder = L.cache_folder([(F.lit("configured"), k % 7 == 0), (F.lit("beside"), k % 3 == 0), (F.lit("user"), k % 2 == 0), (F.lit("temp"), F.lit(True))])
    return X.table(spark, sf, "orders").select("o_orderkey", folder.alias("folder"))


def identity_blocks(spark, sf):
    size = F.floor(F.col("o_totalprice") * 10).cast("long")
    rows = X.table(spark, sf, "orders").select("o_orderkey", F.explode(L.identity_blocks(size)).alias("b"))
    return rows.select("o_orderkey", "b.at", "b.length")


def decode_plan(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("Jpeg", "Svg", "WebP", "Png", "Jxl"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    over = F.col("o_totalprice") > 150_000
    plan = L.decode_plan(kind, F.floor("o_totalprice").cast("long"), F.lit(100), F.col("o_custkey") % 2 == 0, over, 80_000_000, (1920, 1080), 8_000_000)
    return X.table(spark, sf, "orders").select("o_orderkey", plan.alias("p")).select("o_orderkey", "p.*")


def same_size_sheets(spark, sf):
    levels = X.table(spark, sf, "part").select(F.col("p_partkey").alias("level_id"), (F.col("p_size") % 10).alias("w"), (F.col("p_partkey") % 7).alias("h"))
    sheets = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sheet_id"), (F.col("s_suppkey") % 10).cast("int").alias("w"), (F.col("s_suppkey") % 7).alias("h"))
    return L.same_size_sheets(levels, sheets)


def _jobs(spark, sf):
    return X.table(spark, sf, "events").select((F.col("user_id") % 300).alias("session"), (F.col("event_id") % 50).alias("idx"), (F.col("event_id") % 13).alias("rank"), (F.col("event_type") == "click").alias("pending"))


def farthest_running(spark, sf):
    return L.farthest_running(_jobs(spark, sf), 4)


def settled(spark, sf):
    return L.settled(_jobs(spark, sf))


def band_progress(spark, sf):
    bands = X.table(spark, sf, "part").select(F.col("p_partkey").alias("image"), F.explode(F.sequence(F.lit(0), F.col("p_size").cast("int") - 1, F.lit(8))).alias("y"), F.col("p_size").alias("height"))
    return L.progress(bands.withColumn("rows", F.least(F.lit(8), F.col("height") - F.col("y"))))


def memory_shortage(spark, sf):
    orders = X.table(spark, sf, "orders")
    return orders.select("o_orderkey", L.memory_shortage(F.floor(F.col("o_totalprice") * 1000).cast("long"), F.lit(100_000_000).cast("long")).alias("message"))


def replaced_display(spark, sf):
    e = X.table(spark, sf, "events").select((F.col("user_id") % 300).alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("display"), (F.col("event_id") % 2 == 0).alias("hdr"))
    return L.replaced_display(e, e.select("session", "seq", "display"))


def tile_lookup_by_level(spark, sf):
    """Prefetch one level up: the coarser tiles that the tiles of a level lie in."""
    have = X.resident(spark, sf).where("level < 2")
    return have.select((F.col("level") + 1).alias("level"), F.shiftright("column", 1).alias("column"), F.shiftright("row", 1).alias("row")).distinct()


def opaque_images(spark, sf):
    px = X.pixels(spark, sf)
    return L.opaque_images(px.withColumn("a", F.when(F.col("image") % 2 == 0, 0).otherwise(F.col("a"))))


def rows_alone(spark, sf):
    k = F.col("o_orderkey")
    bit = lambda n: F.shiftright(k, n).bitwiseAND(F.lit(1).cast("long")) == 1
    pick = lambda by, *some: F.element_at(F.array(*map(F.lit, some)), (by % len(some) + 1).cast("int"))
    tiff = L.tiff_in_rows(pick(k, 8, 8, 16), (F.shiftright(k, 1) % 4 + 1), pick(k, "uint", "uint", "uint", "float", "uint"), pick(k, *["contig"] * 6, "separate"), pick(F.shiftright(k, 3), "rgb", "minisblack"), k % 11 == 0, bit(4))
    png = L.png_in_rows(pick(k, 8, 16, 4), bit(1), bit(2), bit(3), bit(5))
    return X.table(spark, sf, "orders").select("o_orderkey", tiff.alias("tiff"), png.alias("png"))


def item_properties(spark, sf):
    line = X.frames(spark, sf)
    associations = line.select(F.col("image").alias("file"), F.col("frame").alias("item"), (F.col("frame") % 4).alias("nth"))
    properties = line.select(F.col("image").alias("file"), F.col("frame").alias("ordinal"), F.when(F.col("stated") % 4 == 0, "colr").otherwise("ispe").alias("kind"))
    return L.item_properties(associations, properties)


QUERIES = {
    "opaque_images": (opaque_images, f"WITH {PX} SELECT image, image % 2 = 0 OR max(a) = 0 AS opaque FROM px GROUP BY image"),
    "rows_alone": (
        rows_alone,
        """WITH t AS (SELECT o_orderkey AS k, (o_orderkey >> 1) % 4 + 1 AS n, (o_orderkey >> 3) % 2 = 0 AS rgb FROM orders)
        SELECT k AS o_orderkey, k % 3 < 2 AND k % 5 <> 3 AND k % 7 <> 6 AND k % 11 <> 0 AND CASE WHEN rgb THEN n IN (3, 4) ELSE n IN (1, 2) END AND (n IN (1, 3) OR (k >> 4) & 1 = 1) AS tiff,
          (k >> 5) & 1 = 0 AND (k % 3 = 0 OR (k % 3 = 1 AND (k >> 1) & 1 = 0)) AND ((k >> 3) & 1 = 0 OR ((k >> 1) & 1 = 0 AND (k >> 2) & 1 = 0)) AS png FROM t""",
    ),
    "item_properties": (
        item_properties,
        f"""WITH {FR} SELECT a.image AS file, (a.frame % 4) AS nth, a.frame AS item, CASE WHEN p.stated % 4 = 0 THEN 'colr' ELSE 'ispe' END AS kind
        FROM fr a JOIN fr p ON p.image = a.image AND p.frame = a.frame % 4""",
    ),
    "checkpoint_lookup": (
        checkpoint_lookup,
        """WITH p AS (SELECT p_size::BIGINT AS k, floor(p_retailprice)::BIGINT AS pos, max(p_partkey) AS v FROM part GROUP BY ALL),
        a AS (SELECT o_orderkey % 50 AS k, floor(o_totalprice)::BIGINT % 2500 AS pos, o_orderkey AS id FROM orders)
        SELECT a.k, a.pos AS "at", a.id, p.v AS found FROM a ASOF LEFT JOIN p ON a.k = p.k AND a.pos >= p.pos""",
    ),
    "cache_folder": (
        cache_folder,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'configured' WHEN o_orderkey % 3 = 0 THEN 'beside' WHEN o_orderkey % 2 = 0 THEN 'user' ELSE 'temp' END AS folder FROM orders",
    ),
    "identity_blocks": (
        identity_blocks,
        """WITH s AS (SELECT o_orderkey, floor(o_totalprice * 10)::BIGINT AS n FROM orders)
        SELECT o_orderkey, 0::BIGINT AS "at", n AS length FROM s WHERE n <= 262144
        UNION ALL SELECT o_orderkey, 0, 65536 FROM s WHERE n > 262144 UNION ALL SELECT o_orderkey, n - 65536, 65536 FROM s WHERE n > 262144
        UNION ALL SELECT o_orderkey, 65536 + (n - 135168) * i // 31, 4096 FROM s, range(32) t(i) WHERE n > 262144""",
    ),
    "decode_plan": (
        decode_plan,
        """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k, floor(o_totalprice)::BIGINT AS w, 100 AS h, o_custkey % 2 = 0 AS full_, o_totalprice > 150000 AS over_ FROM orders),
        p AS (SELECT *, CASE WHEN k = 1 THEN 'filled' WHEN k = 0 AND NOT full_ THEN 'preview' WHEN NOT over_ THEN 'capped' WHEN k IN (2, 4) AND w * 400 <= 80000000 THEN 'native' ELSE 'forced' END AS way,
          least(1920 / w, 1080 / h) AS g, CASE WHEN w * h > 8000000 THEN sqrt(8000000 / (w * h)::DOUBLE) ELSE 1 END AS c FROM t),
        s AS (SELECT *, CASE way WHEN 'filled' THEN g WHEN 'preview' THEN least(1, g) ELSE c END AS f FROM p),
        b AS (SELECT *, greatest(floor(w * f), 1)::INT AS box_w, greatest(floor(h * f), 1)::INT AS box_h FROM s)
        SELECT o_orderkey, way, box_w, box_h, way = 'forced' AS force, way <> 'preview' AS whole, box_w::BIGINT * box_h * 16 // 3 + CASE WHEN way = 'native' THEN w * h * 4 ELSE 0 END AS estimate FROM b""",
    ),
    "same_size_sheets": (
        same_size_sheets,
        """SELECT w, h, level_id, min(s_suppkey) AS sheet_id FROM (SELECT p_partkey AS level_id, p_size % 10 AS w, p_partkey % 7 AS h FROM part) l
        JOIN supplier ON s_suppkey % 10 = w AND s_suppkey % 7 = h GROUP BY ALL""",
    ),
    "farthest_running": (
        farthest_running,
        """WITH j AS (SELECT user_id % 300 AS session, event_id % 50 AS idx, event_id % 13 AS rank FROM events)
        SELECT session, idx, rank FROM j QUALIFY count(*) OVER (PARTITION BY session) >= 4 AND row_number() OVER (PARTITION BY session ORDER BY rank DESC, idx DESC) = 1""",
    ),
    "settled": (settled, "SELECT user_id % 300 AS session, bool_and(event_type <> 'click') AS settled FROM events GROUP BY 1"),
    "band_progress": (
        band_progress,
        """SELECT p_partkey AS image, (i * 8)::INT AS y, p_size AS height, least(8, p_size - i * 8)::INT AS "rows", least(p_size, i * 8 + 8) / p_size AS done FROM part, range(20) t(i) WHERE i * 8 < p_size""",
    ),
    "memory_shortage": (
        memory_shortage,
        """WITH t AS (SELECT o_orderkey, floor(o_totalprice * 1000)::BIGINT AS n FROM orders)
        SELECT o_orderkey, CASE WHEN n > 100000000 THEN 'needs ' || (n // 1000000) || ' MB, 100 MB free' END AS message FROM t""",
    ),
    "replaced_display": (
        replaced_display,
        """WITH e AS (SELECT user_id % 300 AS session, event_id AS seq, event_id % 3 AS display, event_id % 2 = 0 AS hdr FROM events), n AS (SELECT session, arg_max(display, seq) AS now FROM e GROUP BY 1)
        SELECT e.* FROM e JOIN n USING (session) WHERE NOT hdr OR display = now""",
    ),
    "coarser_tiles": (
        tile_lookup_by_level,
        """SELECT DISTINCT l_linenumber::INT AS level, ((l_partkey % ceil(16 / power(2, l_linenumber - 1))::INT) // 2)::INT AS "column", ((l_suppkey % ceil(12 / power(2, l_linenumber - 1))::INT) // 2)::INT AS "row"
        FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 11 < 4""",
    ),
}
