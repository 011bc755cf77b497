"""Decisions around a view: what is posted, uploaded, kept warm, read by rows, named, waited for; and folds over a session's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import geometry as G
from ..functions import text as T
from ..operators import codec as C
from ..operators import lookups as L
from ..operators import sessions as S
from ..operators import views as V
from ..sources import fixtures as X
from .fixtures_sql import GRID, REQ, VIEWS


def _bit(k):
    return F.shiftright(F.col("o_orderkey"), k).bitwiseAND(F.lit(1).cast("long")) == 1


def delivered(spark, sf):
    from ..operators.requests import delivered as kind

    flags = dict(zip(("error", "streamed", "tiles", "whole", "scalable"), map(_bit, range(5)), strict=True))
    return X.table(spark, sf, "orders").select("o_orderkey", kind(flags).alias("posted"))


def scan_bands(spark, sf):
    return L.bands(X.views(spark, sf).select(F.col("view").alias("image"), "h"), 128)


def scan_memory(spark, sf):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "Jxl").otherwise("Png")
    return X.table(spark, sf, "orders").select("o_orderkey", L.scan_bytes(kind, F.col("o_custkey"), F.col("o_orderkey") % 5000 + 1, F.col("o_orderkey") % 3 == 0, 256).alias("bytes"))


def _ranges(spark, sf):
    k = F.col("o_orderkey")
    return X.table(spark, sf, "orders").select(
        k.alias("id"), (k % 200 * 8 + F.when(k % 13 == 0, 4).otherwise(0)).alias("top"), (k % 90).alias("count"), F.lit(1500).alias("height"), ((k % 6 + 1) * 16).alias("step_rows"), (k % 2).alias("margin"),
        F.ceil(F.lit(1500) / ((k % 6 + 1) * 16)).alias("steps"), (k % 4 + 1).alias("columns"), (k % 5 * 100 + 64).alias("tile_height"),
    )


_RANGES = """ranges AS (SELECT o_orderkey AS id, o_orderkey % 200 * 8 + CASE WHEN o_orderkey % 13 = 0 THEN 4 ELSE 0 END AS top, o_orderkey % 90 AS n, (o_orderkey % 6 + 1) * 16 AS rows_, o_orderkey % 2 AS margin,
  o_orderkey % 4 + 1 AS cols, o_orderkey % 5 * 100 + 64 AS th FROM orders),
pixels AS (SELECT ranges.*, y FROM ranges, range(1500) t(y) WHERE y >= top AND y < top + n)"""


def restart_rows(spark, sf):
    return L.steps_of_rows(_ranges(spark, sf))


def grid_cells(spark, sf):
    return L.cells_of_rows(_ranges(spark, sf))


def finest_source(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("Tiff", "Heif", "Png", "Jpeg", "WebP"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return X.table(spark, sf, "orders").select("o_orderkey", L.finest_source(kind, _bit(3), _bit(4), _bit(5)).alias("source"))


def stored_channels(spark, sf):
    """Tiles without a use for alpha leave it out."""
    return X.table(spark, sf, "orders").select("o_orderkey", C.stored_channels(_bit(1), F.when(_bit(2), "pq").otherwise("srgb")).alias("channels"))


def expand_grey(spark, sf):
    """Grey of 16 bits, one value of which is clear."""
    px = X.grid(spark, sf).select("image", "x", "y", (F.col("v") * 257 + F.col("x") % 2 * 100).cast("int").alias("s0"))
    return C.expanded(px.where("s0 <= 65535"), "grey", 16, (257,))


def expand_colours(spark, sf):
    """Grey with alpha, and colours of 8 bits with a key."""
    cells = X.grid(spark, sf)
    two = C.expanded(cells.select(F.lit(1).alias("image"), "x", "y", F.col("v").alias("s0"), (F.col("x") * 4).alias("s1")), "grey_alpha", 8)
    three = C.expanded(cells.select(F.lit(2).alias("image"), "x", "y", F.col("v").alias("s0"), (F.col("v") % 7).alias("s1"), (F.col("y") % 2).alias("s2")), "rgb", 8, (250, 5, 1))
    return two.unionByName(three)


def cache_names(spark, sf):
    """The file name of each cache: FNV-1a of what identifies it, in sixteen digits."""
    k = F.col("c_custkey")
    said = T.cache_identity(k * 1000, F.col("c_custkey").cast("decimal(20,0)") * 1000003, F.when(k % 2 == 0, 1.0 + (k + 1) / 8).otherwise(1.0), F.when(k % 3 == 0, 203.0).otherwise(100.0))
    rows = X.table(spark, sf, "customer").select("c_custkey", said.alias("identity"))
    return rows.select("c_custkey", "identity", F.concat(T.hex_digits(B.fnv1a(F.encode("identity", "UTF-8"))), F.lit(".tiles")).alias("file"))


def homes(spark, sf):
    k = F.col("p_partkey")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("~", "~/", "~\\", "/", "~x/", ""))), (k % 6 + 1).cast("int")), F.when(k % 6 == 0, "").otherwise(F.col("p_name")))
    return X.table(spark, sf, "part").select("p_partkey", T.expanded(path, "/home/x").alias("path"))


def zoom_steps(spark, sf):
    return X.table(spark, sf, "events").select("event_id", F.round(G.drag_zoom(F.col("value")), 9).alias("drag"), F.round(G.key_zoom(F.col("event_id") % 9 - 4), 9).alias("keys"))


def upload_turns(spark, sf):
    sizes = spark.createDataFrame([(0, 16, 12), (1, 8, 6)], "level int, columns int, rows int")
    return V.upload_turns(X.views(spark, sf).withColumn("level", F.lit(0)), sizes, 256, 2_000_000)


def keep_warm(spark, sf):
    req = X.requests(spark, sf)
    return V.keep_warm(req.select("session", F.col("idx").alias("image")).distinct(), req.where("generation % 2 = 0").select("session", ((F.col("idx") + 1) % 50).alias("image")))


def wait_ms(spark, sf):
    k = F.col("o_orderkey")
    deadlines = [(_bit(1), k * 2), (_bit(2), k + 100), (_bit(3), k * 3 - 500)]
    return X.table(spark, sf, "orders").select("o_orderkey", S.wait_ms(k + 50, _bit(0), 250, deadlines).alias("wait"))


def view_states(spark, sf):
    """Fits, pans, zooms at a place and centring, by session."""
    k = F.col("generation")
    what = F.element_at(F.array(*map(F.lit, ("fit", "zoom", "pan", "zoom", "centre"))), ((k - 1) % 5 + 1).cast("int"))
    events = X.requests(spark, sf).select("session", k.alias("seq"), what.alias("what"), (F.col("session") % 900 + 100).cast("int").alias("w"), (F.col("session") % 700 + 100).cast("int").alias("h"), F.col("idx").cast("double").alias("a"), (F.col("idx") * 2.0).alias("b"), (1.0 + F.col("idx") % 4 / 2.0).alias("factor"))
    return S.view_states(events, 1920, 1080)


def cache_changes(spark, sf):
    """Entries put, forgotten, turned, rebuilt, and a mode that switches."""
    k = F.col("generation")
    what = F.element_at(F.array(*map(F.lit, ("put", "put", "reoriented", "put", "forget", "put", "rebuild", "stream_all"))), (F.col("idx") % 8 + 1).cast("int"))
    side = (F.col("idx") * 37 + F.col("generation")).cast("int")
    return S.cache_changes(
        X.requests(spark, sf).select(
            (F.col("session") % 40).alias("session"), F.expr("generation * 1000000 + session").alias("seq"), what.alias("what"), (F.col("idx") % 12).cast("long").alias("file"), (F.col("idx") * 100).cast("long").alias("bytes"), (k % 2 == 0).alias("streamed"), side.alias("w"), (side + 5).alias("h"), (F.col("idx") % 8 + 1).cast("int").alias("orientation")
        ),
        500_000,
    )


_FLAGS = lambda n: f"(o_orderkey >> {n}) & 1 = 1"
#: Views one after the other: a fit first, then what each says of the one before.
_VIEWS = f"""WITH RECURSIVE {REQ}, e AS (SELECT session, generation AS seq, (['fit', 'zoom', 'pan', 'zoom', 'centre'])[(generation - 1) % 5 + 1] AS what, (session % 900 + 100)::DOUBLE AS w, (session % 700 + 100)::DOUBLE AS h,
  idx::DOUBLE AS a, idx * 2.0::DOUBLE AS b, 1 + idx % 4 / 2.0::DOUBLE AS f, least(1920 / (session % 900 + 100), 1080 / (session % 700 + 100))::DOUBLE AS fit FROM req),
n AS (SELECT *, greatest(fit * 64, 32) AS top, fit / 64 AS low FROM e),
r AS (SELECT session, seq, (1920 - w * fit) / 2 AS x, (1080 - h * fit) / 2 AS y, fit AS zoom FROM n WHERE seq = 1
  UNION ALL SELECT n.session, n.seq,
    CASE what WHEN 'fit' THEN (1920 - w * fit) / 2 WHEN 'centre' THEN (1920 - w * zoom) / 2 WHEN 'pan' THEN x + a ELSE a - (a - x) / zoom * least(greatest(zoom * f, low), top) END,
    CASE what WHEN 'fit' THEN (1080 - h * fit) / 2 WHEN 'centre' THEN (1080 - h * zoom) / 2 WHEN 'pan' THEN y + b ELSE b - (b - y) / zoom * least(greatest(zoom * f, low), top) END,
    CASE what WHEN 'fit' THEN fit WHEN 'zoom' THEN least(greatest(zoom * f, low), top) ELSE zoom END
  FROM r JOIN n ON n.session = r.session AND n.seq = r.seq + 1)
SELECT session, seq, round(x, 6) AS x, round(y, 6) AS y, round(zoom, 9) AS zoom FROM r"""

QUERIES = {
    "delivered": (
        delivered,
        f"""SELECT o_orderkey, CASE WHEN {_FLAGS(0)} THEN 'failed' WHEN {_FLAGS(1)} AND {_FLAGS(2)} THEN 'full' WHEN {_FLAGS(1)} THEN 'building'
        WHEN {_FLAGS(3)} OR {_FLAGS(4)} THEN 'full' ELSE 'preview' END AS posted FROM orders""",
    ),
    "scan_bands": (scan_bands, f"""WITH {VIEWS} SELECT view AS image, b::BIGINT AS band, b * 128 AS y, least(128, h - b * 128)::INT AS "rows" FROM views, range(10) t(b) WHERE b * 128 < h"""),
    "scan_memory": (
        scan_memory,
        """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_custkey::DOUBLE * (o_orderkey % 5000 + 1) * CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 2.8::DOUBLE END + o_custkey::DOUBLE * 256 * 4 * 5)::BIGINT ELSE 0 END AS bytes FROM orders""",
    ),
    # each row of pixels says which step or cell it is in; margins are the steps beside those
    "restart_rows": (
        restart_rows,
        f"""WITH {_RANGES}, seen AS (SELECT DISTINCT id, y // rows_ AS step, margin, (1500 + rows_ - 1) // rows_ AS steps FROM pixels WHERE top % 8 = 0),
        wide AS (SELECT id, step + d AS step, max(d = 0) AS shown FROM seen, (VALUES (-1), (0), (1)) q(d) WHERE abs(d) <= margin AND step + d BETWEEN 0 AND steps - 1 GROUP BY ALL) SELECT id, step::BIGINT AS step, shown FROM wide""",
    ),
    "grid_cells": (grid_cells, f"""WITH {_RANGES} SELECT DISTINCT id, (y // th)::BIGINT AS "row", c::BIGINT AS "column" FROM pixels, range(4) t(c) WHERE c < cols"""),
    "finest_source": (
        finest_source,
        f"""SELECT o_orderkey, CASE WHEN {_FLAGS(5)} THEN CASE o_orderkey % 5 WHEN 0 THEN 'strips' WHEN 1 THEN 'grid' WHEN 2 THEN CASE WHEN {_FLAGS(3)} OR {_FLAGS(4)} THEN 'points' END WHEN 3 THEN 'restarts' END END AS source FROM orders""",
    ),
    "stored_channels": (stored_channels, f"SELECT o_orderkey, CASE WHEN {_FLAGS(1)} OR {_FLAGS(2)} THEN 4 ELSE 3 END AS channels FROM orders"),
    "expand_grey": (
        expand_grey,
        f"""WITH {GRID}, s AS (SELECT *, v * 257 + x % 2 * 100 AS s FROM grid), e AS (SELECT *, round(s / 257.0)::INT AS e FROM s WHERE s <= 65535)
        SELECT image, x, y, e AS r, e AS g, e AS b, CASE WHEN s = 257 THEN 0 ELSE 255 END AS a FROM e""",
    ),
    "expand_colours": (
        expand_colours,
        f"""WITH {GRID} SELECT 1 AS image, x, y, v AS r, v AS g, v AS b, x * 4 AS a FROM grid
        UNION ALL SELECT 2, x, y, v, v % 7, y % 2, CASE WHEN v = 250 AND y % 2 = 1 THEN 0 ELSE 255 END FROM grid""",
    ),
    "cache_names": (
        cache_names,
        """WITH RECURSIVE t AS (SELECT c_custkey, (c_custkey * 1000) || '|' || printf('%016x', c_custkey * 1000003) ||
          CASE WHEN c_custkey % 2 = 0 THEN '|pq|' || printf('%.2f', 1 + (c_custkey + 1) / 8.0::DOUBLE) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '|100' END ELSE '' END AS s FROM customer),
        f AS (SELECT c_custkey, s, 0 AS i, 14695981039346656037::UHUGEINT AS h FROM t
          UNION ALL SELECT c_custkey, s, i + 1, (xor(h, ascii(substr(s, i + 1, 1))::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM f WHERE i < length(s))
        SELECT c_custkey, s AS identity, printf('%08x', (h // 4294967296)::BIGINT) || printf('%08x', (h % 4294967296)::BIGINT) || '.tiles' AS file FROM f WHERE i = length(s)""",
    ),
    "homes": (
        homes,
        """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '/home/x' WHEN 1 THEN '/home/x/' || p_name WHEN 2 THEN '/home/x/' || p_name WHEN 3 THEN '/' || p_name WHEN 4 THEN '~x/' || p_name ELSE p_name END AS path FROM part""",
    ),
    "zoom_steps": (zoom_steps, "SELECT event_id, round(exp(0.005::DOUBLE * value), 9) AS drag, round(pow(sqrt(2), event_id % 9 - 4), 9) AS keys FROM events"),
    "upload_turns": (
        upload_turns,
        f"""WITH {VIEWS}, every AS (SELECT 0 AS level, c, q, 256 AS s FROM range(16) a(c), range(12) b(q) UNION ALL SELECT 1, c, q, 512 FROM range(8) a(c), range(6) b(q)),
        u AS (SELECT view, x, y, w, h, x // 2 * 2 AS x1, y // 2 * 2 AS y1, (x // 2 + (w + 1) // 2) * 2 AS r1, (y // 2 + (h + 1) // 2) * 2 AS d1 FROM views),
        t AS (SELECT view, level, c, q,
          CASE WHEN level = 0 THEN c * 256 < x + w AND (c + 1) * 256 > x AND q * 256 < y + h AND (q + 1) * 256 > y ELSE c * 512 < r1 AND (c + 1) * 512 > x1 AND q * 512 < d1 AND (q + 1) * 512 > y1 END AS inside,
          CASE WHEN level = 0 THEN c * 256 < x + w + 256 AND (c + 1) * 256 > x - 256 AND q * 256 < y + h + 256 AND (q + 1) * 256 > y - 256
            ELSE c * 512 < r1 + 512 AND (c + 1) * 512 > x1 - 512 AND q * 512 < d1 + 512 AND (q + 1) * 512 > y1 - 512 END AS near FROM u, every),
        n AS (SELECT view, count(*) AS n FROM t WHERE level = 0 AND inside GROUP BY view)
        SELECT view, level, c::BIGINT AS "column", q::BIGINT AS "row", CASE WHEN level = 0 AND inside THEN 1 WHEN level = 0 THEN 2 WHEN inside AND n * 262144 > 2000000 THEN 0 ELSE 3 END AS turn FROM t JOIN n USING (view) WHERE near""",
    ),
    "keep_warm": (keep_warm, f"WITH {REQ} SELECT DISTINCT session, idx AS image FROM req r WHERE EXISTS (SELECT 1 FROM req k WHERE k.session = r.session AND k.generation % 2 = 0 AND (k.idx + 1) % 50 = r.idx)"),
    "wait_ms": (
        wait_ms,
        f"""WITH t AS (SELECT o_orderkey, least(CASE WHEN {_FLAGS(0)} THEN 250 END, CASE WHEN {_FLAGS(1)} THEN greatest(o_orderkey * 2 - o_orderkey - 50, 0) END,
          CASE WHEN {_FLAGS(2)} THEN 50 END, CASE WHEN {_FLAGS(3)} THEN greatest(o_orderkey * 3 - 500 - o_orderkey - 50, 0) END) AS w FROM orders) SELECT o_orderkey, coalesce(w, -1)::BIGINT AS wait FROM t""",
    ),
    "view_states": (view_states, _VIEWS),
    "cache_changes": (cache_changes, None),
}
