"""Tone and colour, over light levels from the events' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import geometry as G
from ..functions import tone as T
from ..sources import fixtures as X
from .fixtures_sql import GRID

_SRGB_E = "CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * power({v}, 1 / 2.4::DOUBLE) - 0.055 END"
_PQ = f"power(({T.C1!r}::DOUBLE + {T.C2!r}::DOUBLE * power({{v}}, {T.M1!r}::DOUBLE)) / (1 + {T.C3!r}::DOUBLE * power({{v}}, {T.M1!r}::DOUBLE)), {T.M2!r}::DOUBLE)"
_LIGHT = "light AS (SELECT event_id, abs(value) / 100.0::DOUBLE AS v FROM events)"


def _light(spark, sf):
    return X.table(spark, sf, "events").select("event_id", (F.abs("value") / 100.0).alias("v"))


def pq_signal(spark, sf):
    v = F.col("v")
    return _light(spark, sf).select("event_id", F.round(T.pq_encoded(F.least(v / 49, F.lit(1.0))), 6).alias("signal"), T.pq_code(v).alias("code"), F.round(T.pq_nits(T.pq_encoded(F.least(v / 49, F.lit(1.0)))), 3).alias("nits"))


def hlg(spark, sf):
    v = F.least(F.col("v") / 5, F.lit(1.0))
    return _light(spark, sf).select("event_id", F.round(T.hlg_light(v), 9).alias("light"), F.round(T.hlg_gain(T.hlg_light(v)), 9).alias("gain"))


def srgb_table(spark, sf):
    v = F.col("v")
    return _light(spark, sf).select("event_id", T.srgb_code(v).alias("code"), F.round(T.srgb_decode(F.least(v, F.lit(1.0))), 9).alias("light"), T.alpha_code(v).alias("alpha"))


def cicp(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).cast("int").alias("c"))
    return orders.select("o_orderkey", T.transfer_of_cicp(F.col("c")).alias("transfer"), T.primaries_of_cicp(F.col("c")).alias("primaries"))


def rolloff(spark, sf):
    return _light(spark, sf).select("event_id", F.round(T.rolloff_scale(F.col("v")), 9).alias("sdr"), F.round(T.rolloff_scale(F.col("v"), 4.0), 9).alias("hdr"))


def matrix(spark, sf):
    rows = [(a, b, i, j, round(T.conversion(a, b)[i][j], 6)) for a in T.PRIMARIES for b in T.PRIMARIES for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "source string, target string, i int, j int, value double")


def convert_colours(spark, sf):
    px = X.pixels(spark, sf).select("image", "x", "y", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    out = T.apply_matrix(T.conversion("bt2020", "bt709"), *[F.col(c) for c in "rgb"])
    return px.select("image", "x", "y", *[F.round(T.finite(v), 6).alias(c) for c, v in zip("rgb", out, strict=True)])


def _m(a, b):
    return T.conversion(a, b)


def gain_weight(spark, sf):
    events = X.table(spark, sf, "events").select("event_id", (F.col("event_id") % 9 / 2.0).alias("h"), (F.col("event_id") % 4).cast("double").alias("b"), (F.col("event_id") % 5).cast("double").alias("a"))
    return events.select("event_id", F.round(T.gain_weight(F.col("h"), F.col("b"), F.col("a")), 9).alias("weight"))


#: A gain map of 13 x 9 over an image of 61 x 37; metadata of one channel.
_MAP_W, _MAP_H, _LOW, _HIGH, _GAMMA, _WEIGHT = 13, 9, 0.1, 2.0, 1.5, 0.75


def gain_apply(spark, sf):
    """Each pixel's four neighbours in the map: a fixed number of equi-joins on the small map, then blended."""
    grid = X.grid(spark, sf)
    gain = grid.where(f"x < {_MAP_W} and y < {_MAP_H}").select(F.col("x").alias("mx"), F.col("y").alias("my"), F.col("v").alias("m"))
    axis = lambda at, small, large: F.least(F.greatest((F.col(at) + 0.5) * small / large - 0.5, F.lit(0.0)), F.lit(float(small - 1)))
    at = grid.withColumns({"fx": axis("x", _MAP_W, 61), "fy": axis("y", _MAP_H, 37)}).withColumns({"x0": F.floor("fx"), "y0": F.floor("fy")})
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = at.withColumn("c", F.explode(corners)).withColumns(
        {"mx": F.least(F.col("x0") + F.col("c.i"), F.lit(_MAP_W - 1)).cast("int"), "my": F.least(F.col("y0") + F.col("c.j"), F.lit(_MAP_H - 1)).cast("int")}
    )
    k = lambda f, b, i: F.when(F.col(i) == 1, F.col(f) - F.col(b)).otherwise(1 - (F.col(f) - F.col(b)))
    part = spread.join(gain, ["mx", "my"]).select("x", "y", "v", (F.col("m") * k("fx", "x0", "c.i") * k("fy", "y0", "c.j")).alias("p"))
    value = part.groupBy("x", "y", "v").agg(F.sum("p").alias("p"))
    slot = F.floor(F.round(F.col("p"), 9) * 1023 / 255 + 0.5)
    light = (F.col("v") / 255.0 + 0.015625) * T.gain_factor(slot, _LOW, _HIGH, _GAMMA, F.lit(_WEIGHT)) - 0.015625
    return value.select("x", "y", F.round(light, 6).alias("light"))


def display(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2000 + 100.0).alias("peak"), (F.col("o_orderkey") % 300 + 80.0).alias("cfg"))
    white = T.display_white(F.col("cfg"), F.col("peak"))
    return orders.select("o_orderkey", white.alias("white"), F.round(T.display_headroom(F.col("peak"), white), 2).alias("headroom"))


def widen_channels(spark, sf):
    px = X.pixels(spark, sf)
    return px.select("image", "x", "y", T.widen(F.col("r")).alias("r16"), T.masked_channel(F.col("r") % 32, 5).alias("r5"), T.masked_channel(F.col("r") * 4, 10).alias("r10"))


def fit_box(spark, sf):
    w, h = F.col("w"), F.col("h")
    size = X.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 37 % 9000 + 1).cast("int").alias("w"), (F.col("p_partkey") * 91 % 7000 + 1).cast("int").alias("h"))
    fw, fh = G.fitted(w, h, 1920, 1080)
    gw, gh = G.filled(w, h, 1920, 1080)
    cw, ch = G.capped(w, h, 8_000_000)
    return size.select(
        "p_partkey", fw.alias("fit_w"), fh.alias("fit_h"), gw.alias("fill_w"), gh.alias("fill_h"), cw.alias("cap_w"), ch.alias("cap_h"),
        G.shrink_factor(w, h, 1920, 1080).alias("factor"), G.jpeg_scale(w, h, fw, fh, F.lit(1), F.lit(False)).alias("eighths"), G.cell_side(F.least(w, F.lit(2000)), F.least(h, F.lit(2000))).alias("cell"),
        G.scaled_rows(h, F.lit(3)).alias("rows"),
    )


_FIT = """WITH t AS (SELECT p_partkey, (p_partkey * 37 % 9000 + 1) AS w, (p_partkey * 91 % 7000 + 1) AS h FROM part),
s AS (SELECT *, least(1, least(1920 / w, 1080 / h)) AS f, least(1920 / w, 1080 / h) AS g, CASE WHEN w * h > 8000000 THEN sqrt(8000000 / (w * h)::DOUBLE) ELSE 1 END AS c FROM t),
r AS (SELECT *, greatest(floor(w * f), 1)::INT AS fit_w, greatest(floor(h * f), 1)::INT AS fit_h FROM s)
SELECT p_partkey, fit_w, fit_h, greatest(floor(w * g), 1)::INT AS fill_w, greatest(floor(h * g), 1)::INT AS fill_h, greatest(floor(w * c), 1)::INT AS cap_w, greatest(floor(h * c), 1)::INT AS cap_h,
  (SELECT min(k) FROM range(1, 20) q(k) WHERE ceil(w / k) <= 1920 AND ceil(h / k) <= 1080)::INT AS factor,
  coalesce((SELECT min(n) FROM (VALUES (1), (2), (4)) v(n) WHERE ceil(w * n / 8) >= fit_w AND ceil(h * n / 8) >= fit_h), 8)::INT AS eighths,
  (SELECT min(n) FROM (VALUES (256), (512), (1024), (2048)) v(n) WHERE n >= least(greatest(w, h), 2000))::INT AS cell, ceil(h * 3 / 8)::INT AS "rows" FROM r"""


def restart_layout(spark, sf):
    part = X.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 37 % 9000 + 16).alias("w"), (F.col("p_partkey") * 91 % 7000 + 16).alias("h"), (F.col("p_size") * 3).cast("long").alias("interval"))
    k = F.col("p_partkey")
    found = G.restart_layout(F.col("w"), F.col("h"), F.col("interval"), k % 2 + 1, k % 3 % 2 + 1, F.when(k % 5 == 0, 1).otherwise(3), k % 3 == 1)
    return part.select("p_partkey", found.alias("s")).select("p_partkey", "s.*")


def jpeg_scale(spark, sf):
    """Cheap and forced, upright and turned, over boxes of several sizes."""
    k = F.col("p_partkey")
    w, h, bw, bh = (k * 37 % 9000 + 1).cast("int"), (k * 91 % 7000 + 1).cast("int"), (k * 13 % 3000 + 1).cast("int"), (k * 29 % 2000 + 1).cast("int")
    turn = (k % 8 + 1).cast("int")
    return X.table(spark, sf, "part").select("p_partkey", *[G.jpeg_scale(w, h, bw, bh, turn, F.lit(f)).alias(n) for n, f in (("cheap", False), ("forced", True))])


_SCALE = """WITH t AS (SELECT p_partkey, p_partkey * 37 % 9000 + 1 AS w, p_partkey * 91 % 7000 + 1 AS h, p_partkey * 13 % 3000 + 1 AS u, p_partkey * 29 % 2000 + 1 AS v, p_partkey % 8 >= 4 AS swapped FROM part),
b AS (SELECT p_partkey, w, h, CASE WHEN swapped THEN v ELSE u END AS bw, CASE WHEN swapped THEN u ELSE v END AS bh FROM t)
SELECT p_partkey, coalesce((SELECT min(n) FROM (VALUES (1), (2), (4), (8)) q(n) WHERE (w * n + 7) // 8 >= bw AND (h * n + 7) // 8 >= bh), 8)::INT AS cheap,
  coalesce((SELECT max(n) FROM (VALUES (1), (2), (4), (8)) q(n) WHERE (w * n + 7) // 8 <= bw AND (h * n + 7) // 8 <= bh), 1)::INT AS forced FROM b"""


def refine_request(spark, sf):
    """A part on screen of an image that lies shifted and zoomed, upright and turned by a quarter."""
    k = F.col("o_orderkey")
    zoom = (k % 7 + 1) / 2.0
    w, h = (k % 900 + 50).cast("double"), (F.col("o_custkey") % 700 + 50).cast("double")
    out = None
    for name, turn in (("upright", (False, 0)), ("turned", (False, 1))):
        sides = (w, h) if name == "upright" else (h, w)
        image = {"x": (k % 500 - 400).cast("double"), "y": (k % 300 - 250).cast("double"), "w": w * zoom, "h": h * zoom}
        part = X.table(spark, sf, "orders").select("o_orderkey", F.lit(name).alias("way"), G.refine_request(image, (F.lit(800.0), F.lit(600.0)), sides, zoom, turn).alias("r"))
        out = part if out is None else out.unionByName(part)
    return out.select("o_orderkey", "way", "r.*")


_REFINE = """WITH t AS (SELECT o_orderkey, (o_orderkey % 7 + 1) / 2.0::DOUBLE AS z, (o_orderkey % 900 + 50)::DOUBLE AS w, (o_custkey % 700 + 50)::DOUBLE AS h, (o_orderkey % 500 - 400)::DOUBLE AS ix, (o_orderkey % 300 - 250)::DOUBLE AS iy FROM orders),
s AS (SELECT *, greatest(ix, 0) - 200 AS l, greatest(iy, 0) - 150 AS u, least(ix + w * z, 800) + 200 AS r, least(iy + h * z, 600) + 150 AS d, least(ix + w * z, 800) > greatest(ix, 0) AND least(iy + h * z, 600) > greatest(iy, 0) AS seen FROM t),
n AS (SELECT *, greatest(0, least(1, (l - ix) / (w * z))) AS x0, greatest(0, least(1, (r - ix) / (w * z))) AS x1, greatest(0, least(1, (u - iy) / (h * z))) AS y0, greatest(0, least(1, (d - iy) / (h * z))) AS y1 FROM s),
q AS (SELECT o_orderkey, 'upright' AS way, seen, x0 AS a, y0 AS b, x1 - x0 AS c, y1 - y0 AS e, w * z AS sw, h * z AS sh FROM n
  UNION ALL SELECT o_orderkey, 'turned', seen, least(1 - y0, 1 - (y0 + (y1 - y0))), least(x0, x0 + (x1 - x0)), abs((1 - (y0 + (y1 - y0))) - (1 - y0)), abs(x0 + (x1 - x0) - x0), h * z, w * z FROM n),
f AS (SELECT *, floor(a * sw)::INT AS x, floor(b * sh)::INT AS y FROM q)
SELECT o_orderkey, way, CASE WHEN seen THEN x END AS x, CASE WHEN seen THEN y END AS y, CASE WHEN seen THEN ceil((a + c) * sw)::INT - x END AS width, CASE WHEN seen THEN ceil((b + e) * sh)::INT - y END AS height FROM f"""


def budgets(spark, sf):
    raw = F.floor(F.col("o_totalprice") * 100_000).cast("long")
    orders = X.table(spark, sf, "orders")
    return orders.select("o_orderkey", G.memory_bytes(raw, F.col("o_orderkey") % 2 == 0).alias("memory"), G.max_pixels(raw * 10).alias("pixels"), G.cache_budget(raw).alias("cache"))


def zoom(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 3000 + 100).cast("double").alias("w"), (F.col("o_custkey") % 2000 + 100).cast("double").alias("h"))
    fit = G.fit_zoom(F.lit(1920.0), F.lit(1080.0), F.col("w"), F.col("h"))
    new, x = G.zoom_at((1920 - F.col("w") * fit) / 2, fit, F.lit(700.0), F.lit(G.KEY_STEP), fit)
    return orders.select("o_orderkey", F.round(fit, 9).alias("fit"), F.round(new, 9).alias("zoom"), F.round(x, 6).alias("x"), G.detail_wins(fit, new, F.lit(1.0)).alias("detail"))


def kinds(spark, sf):
    """Which formats scale cheaply, scale freely, and can save an orientation."""
    rows = spark.createDataFrame([(k,) for k in (*B.FORMAT_NAMES, "Other")], "kind string")
    return rows.select("kind", B.format_name(F.col("kind")).alias("name"), B.scales_cheaply(F.col("kind")).alias("cheap"), B.scalable(F.col("kind")).alias("free"), B.can_save_orientation(F.col("kind")).alias("saves"))


_MATRIX_SQL = None  # constants computed on the driver; tests hold them against published matrices
_CONV = _m("bt2020", "bt709")
_DOT = ", ".join(f"round(CASE WHEN {d} <= 0 THEN 0 ELSE least({d}, 1e6) END, 6) AS {c}" for c, d in (("rgb"[i], " + ".join(f"{_CONV[i][j]!r}::DOUBLE * {'rgb'[j]}" for j in range(3))) for i in range(3)))
_GAIN = f"""WITH {GRID}, p AS (SELECT x, y, v, least(greatest((x + 0.5) * {_MAP_W} / 61::DOUBLE - 0.5, 0), {_MAP_W - 1}) AS fx, least(greatest((y + 0.5) * {_MAP_H} / 37::DOUBLE - 0.5, 0), {_MAP_H - 1}) AS fy FROM grid),
q AS (SELECT p.x, p.y, p.v, fx - floor(fx) AS u, fy - floor(fy) AS w, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM p
  JOIN grid a ON a.x = floor(fx) AND a.y = floor(fy) JOIN grid b ON b.x = least(floor(fx) + 1, {_MAP_W - 1}) AND b.y = floor(fy)
  JOIN grid c ON c.x = floor(fx) AND c.y = least(floor(fy) + 1, {_MAP_H - 1}) JOIN grid d ON d.x = least(floor(fx) + 1, {_MAP_W - 1}) AND d.y = least(floor(fy) + 1, {_MAP_H - 1})),
s AS (SELECT x, y, v, floor(round(a * (1 - u) * (1 - w) + b * u * (1 - w) + c * (1 - u) * w + d * u * w, 9) * 1023 / 255 + 0.5) AS slot FROM q)
SELECT x, y, round((v / 255.0::DOUBLE + 0.015625) * power(2, ({_LOW} + ({_HIGH} - {_LOW})::DOUBLE * power(slot / 1023, 1 / {_GAMMA}::DOUBLE)) * {_WEIGHT}) - 0.015625, 6) AS light FROM s"""

QUERIES = {
    "pq_signal": (
        pq_signal,
        f"""WITH {_LIGHT}, s AS (SELECT event_id, v, least(v / 49, 1) AS share, power(floor(sqrt(least(v * 203 / 10000::DOUBLE, 1)) * 16383 + 0.5) / 16383, 2) AS q FROM light)
        SELECT event_id, round({_PQ.format(v='share')}, 6) AS signal, floor({_PQ.format(v='q')} * 1023 + 0.5)::INT AS code, round(share * 10000, 3) AS nits FROM s""",
    ),
    "hlg": (
        hlg,
        f"""WITH {_LIGHT}, l AS (SELECT event_id, CASE WHEN least(v / 5, 1) <= 0.5 THEN power(least(v / 5, 1), 2) / 3 ELSE (exp((least(v / 5, 1) - {T.HLG_C!r}::DOUBLE) / {T.HLG_A}::DOUBLE) + {T.HLG_B!r}::DOUBLE) / 12 END AS light FROM light)
        SELECT event_id, round(light, 9) AS light, round(CASE WHEN light > 0 THEN 1000 / 203.0::DOUBLE * power(light, 0.2::DOUBLE) ELSE 0 END, 9) AS gain FROM l""",
    ),
    "srgb_table": (
        srgb_table,
        f"""WITH {_LIGHT}, s AS (SELECT event_id, v, least(v, 1) AS c, floor(least(v, 1) * 16383 + 0.5) / 16383 AS q FROM light)
        SELECT event_id, floor(({_SRGB_E.format(v='q')}) * 255 + 0.5)::INT AS code, round(CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE power((c + 0.055) / 1.055, 2.4::DOUBLE) END, 9) AS light,
          floor(c * 3 + 0.5)::INT AS alpha FROM s""",
    ),
    "cicp": (
        cicp,
        """SELECT o_orderkey, CASE o_orderkey % 20 WHEN 8 THEN 'linear' WHEN 16 THEN 'pq' WHEN 18 THEN 'hlg' ELSE 'sdr' END AS transfer,
        CASE o_orderkey % 20 WHEN 9 THEN 'bt2020' WHEN 11 THEN 'p3' WHEN 12 THEN 'p3' ELSE 'bt709' END AS primaries FROM orders""",
    ),
    "rolloff": (
        rolloff,
        f"""WITH {_LIGHT} SELECT event_id, round(CASE WHEN v > 0.8 THEN (0.8 + 0.2 * (v - 0.8) / (v - 0.8 + 0.2)) / v ELSE 1 END, 9) AS sdr,
        round(CASE WHEN v > 3.2 THEN (3.2 + 0.8 * (v - 3.2) / (v - 3.2 + 0.8)) / v ELSE 1 END, 9) AS hdr FROM light""",
    ),
    "matrix": (matrix, _MATRIX_SQL),
    "convert_colours": (convert_colours, f"WITH px AS (SELECT image, x, y, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM base) SELECT image, x, y, {_DOT} FROM px"),
    "gain_weight": (
        gain_weight,
        """WITH t AS (SELECT event_id, event_id % 9 / 2.0::DOUBLE AS h, event_id % 4 AS b, event_id % 5 AS a FROM events)
        SELECT event_id, round(CASE WHEN a = b THEN 0 WHEN a < b THEN 0 - least(greatest((h - b) / (a - b), 0), 1) ELSE least(greatest((h - b) / (a - b), 0), 1) END, 9) AS weight FROM t""",
    ),
    "gain_apply": (gain_apply, _GAIN),
    "display": (
        display,
        """WITH t AS (SELECT o_orderkey, o_orderkey % 2000 + 100.0::DOUBLE AS peak, o_orderkey % 300 + 80.0::DOUBLE AS cfg FROM orders)
        SELECT o_orderkey, least(cfg, peak / 1.25) AS white, round(round(peak / least(cfg, peak / 1.25) * 100) / 100, 2) AS headroom FROM t""",
    ),
    "widen_channels": (widen_channels, "SELECT image, x, y, r * 257 AS r16, ((r % 32 * 255 + 15) // 31)::INT AS r5, r AS r10 FROM base"),
    "fit_box": (fit_box, _FIT),
    "restart_layout": (
        restart_layout,
        """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 8 ELSE (p_partkey % 2 + 1) * 8 END AS mw, CASE WHEN p_partkey % 5 = 0 THEN 8 ELSE (p_partkey % 3 % 2 + 1) * 8 END AS mh FROM part),
        t AS (SELECT p_partkey, mh, ceil((p_partkey * 37 % 9000 + 16) / mw)::BIGINT AS per, ceil((p_partkey * 91 % 7000 + 16) / mh)::BIGINT AS n, (p_size * 3)::BIGINT AS i FROM part JOIN s USING (p_partkey)),
        u AS (SELECT *, i // gcd(i, per) AS k FROM t), v AS (SELECT *, i > 0 AND k * mh <= 1024 AS ok FROM u)
        SELECT p_partkey, CASE WHEN ok THEN k * mh END AS step_rows, CASE WHEN ok THEN k * per // i END AS step_intervals, CASE WHEN ok THEN ceil(per * n / i)::BIGINT END AS intervals,
          CASE WHEN ok THEN ceil(n / k)::BIGINT END AS steps, CASE WHEN ok THEN CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 1 THEN 1 ELSE 0 END END AS margin FROM v""",
    ),
    "jpeg_scale": (jpeg_scale, _SCALE),
    "refine_request": (refine_request, _REFINE),
    "budgets": (
        budgets,
        """WITH t AS (SELECT o_orderkey, floor(o_totalprice * 100000)::BIGINT AS raw FROM orders)
        SELECT o_orderkey, raw // 3 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE raw // 2 END AS memory, greatest(floor(raw * 10 * 3 / 32)::BIGINT, 128000000) AS pixels, greatest(raw // 3, 536870912) AS cache FROM t""",
    ),
    "zoom": (
        zoom,
        """WITH t AS (SELECT o_orderkey, (o_orderkey % 3000 + 100)::DOUBLE AS w, (o_custkey % 2000 + 100)::DOUBLE AS h FROM orders),
        f AS (SELECT *, least(1920 / w, 1080 / h) AS fit FROM t), z AS (SELECT *, least(greatest(fit * sqrt(2), fit / 64), greatest(fit * 64, 32)) AS zoom, (1920 - w * fit) / 2 AS x0 FROM f)
        SELECT o_orderkey, round(fit, 9) AS fit, round(zoom, 9) AS zoom, round(700 - (700 - x0) / fit * zoom, 6) AS x, abs(ln(fit)) < abs(ln(zoom)) AS detail FROM z""",
    ),
    "kinds": (
        kinds,
        """SELECT * FROM (VALUES ('Jpeg', 'JPEG', true, false, true), ('Png', 'PNG', false, false, true), ('WebP', 'WEBP', false, false, true), ('Jxl', 'JXL', false, false, false),
        ('Gif', 'GIF', false, false, false), ('Bmp', 'BMP', false, false, false), ('Ico', 'ICO', false, false, false), ('Icns', 'ICNS', false, false, false), ('Tiff', 'TIFF', false, false, true),
        ('Heif', 'HEIF', false, false, false), ('Svg', 'SVG', true, true, false), ('Pdf', 'PDF', true, true, false), ('Other', NULL, false, false, false)) t(kind, name, cheap, free, saves)""",
    ),
}


def _with_base():
    from .fixtures_sql import PX

    for name in ("convert_colours", "widen_channels"):
        query, sql = QUERIES[name]
        QUERIES[name] = (query, f"SELECT * FROM (WITH {PX}, base AS (SELECT * FROM px) SELECT * FROM ({sql.replace('WITH px AS', 'WITH scaled AS').replace('FROM px', 'FROM scaled')}))")


_with_base()
