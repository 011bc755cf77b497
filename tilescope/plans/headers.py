"""Formats and headers from bytes, settings files, properties, checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..sources import config as G
from ..sources import fixtures as X
from ..sources import headers as H
from ..sources import tiles as S
from .fixtures_sql import FR

#: Byte strings with real magic numbers; the rest of each is zero.
HEADS = {
    1: "FFD8FFE000104A46", 2: "89504E470D0A1A0A0000000D49484452000001F40000012C", 3: "524946460000000057454250", 4: "FF0A0000", 5: "0000000C4A584C200D0A870A",
    6: "474946383961F401A0000000", 7: "424D0000000000000000000000002800000040060000B0040000", 8: "000001000200", 9: "69636E7300000010", 10: "49492A0008000000", 11: "4D4D002A00000008",
    12: "000000186674797068656963", 13: "255044462D312E37", 14: "3C3F786D6C2076657273696F6E", 15: "3C73766720786D6C6E73", 16: "00000100000000", 17: "", 18: "68656C6C6F",
}
NAMES = ("JPEG", "PNG", "WEBP", "JXL", "JXL", "GIF", "BMP", "ICO", "ICNS", "TIFF", "TIFF", "HEIF", "PDF", "SVG", "SVG", None, None, None)
KINDS = ("Jpeg", "Png", "WebP", "Jxl", "Jxl", "Gif", "Bmp", "Ico", "Icns", "Tiff", "Tiff", "Heif", "Pdf", "Svg", "Svg", "Other", "Other", "Other")


def _blobs(spark, sf):
    heads = spark.createDataFrame([(k, bytearray.fromhex(v)) for k, v in HEADS.items()], "id bigint, content binary")
    docs = X.table(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("id"), F.encode("text", "UTF-8").alias("content"))
    return heads.unionByName(docs)


def sniff(spark, sf):
    kind = B.sniff(F.col("content"))
    return _blobs(spark, sf).select("id", kind.alias("kind"), B.format_name(kind).alias("name"), (kind != "Other").alias("recognised"))


_HEADS_SQL = ", ".join(f"({k}, '{kind}', {('NULL' if name is None else repr(name))})" for k, kind, name in zip(HEADS, KINDS, NAMES, strict=True))


def header_sizes(spark, sf):
    """Sides from headers: PNG big-endian, GIF and BMP little-endian."""
    rows = _blobs(spark, sf).withColumn("kind", B.sniff(F.col("content")))
    c = F.col("content")
    size = F.when(F.col("kind") == "Png", B.png_size(c)).when(F.col("kind") == "Gif", B.gif_size(c)).when(F.col("kind") == "Bmp", B.bmp_size(c))
    return rows.select("id", size.alias("s")).where("s is not null").select("id", "s.width", "s.height")


def _tiff(order: str, tag: int, value: int) -> bytes:
    import struct

    o = {"II": "<", "MM": ">"}[order]
    head = order.encode() + struct.pack(o + "HI", 42, 8)
    return head + struct.pack(o + "HHHIHH", 1, tag, 3, 1, value, 0) + b"\0\0\0\0"


def exif_orientation(spark, sf):
    rows = [(10 * i + v, bytearray((b"Exif\0\0" if v % 2 else b"") + _tiff(o, 0x0112, v))) for i, o in enumerate(("II", "MM")) for v in range(0, 10)]
    rows += [(100, bytearray(_tiff("II", 0x0100, 6))), (101, bytearray(b"garbage")), (102, bytearray(b""))]
    return H.orientations(spark.createDataFrame(rows, "id bigint, content binary"))


def _chunk(kind: str, body: bytes) -> bytes:
    import struct

    return kind.encode() + struct.pack(">I", len(body) + 8) + body


def icns_mask(spark, sf):
    """Chunks of icon files, the packed icon of each with its mask: a left join, the last matching chunk wins."""
    files = []
    for k in range(1, 21):
        body = _chunk("is32", b"x" * (k + 4)) + (_chunk("s8mk", b"m" * k) if k % 3 else b"") + (_chunk("s8mk", b"n" * (k + 1)) if k % 4 == 0 else b"")
        files.append((k, bytearray(_chunk("icns", body))))
    parts = H.walk(spark.createDataFrame(files, "id bigint, content binary"), "icns")
    masks = parts.where("name = 's8mk'").groupBy("id").agg(F.max_by("length", "seq").alias("mask"))
    return parts.where("name = 'is32'").select("id", F.col("length").alias("icon")).join(masks, "id", "left")


def icon_largest(spark, sf):
    """The largest entry of an icon directory: area, then depth up to 63; the first wins ties."""
    part = X.table(spark, sf, "part")
    entries = part.select((F.col("p_partkey") % 40).alias("icon"), F.col("p_partkey").alias("seq"), (F.col("p_size") * 4).alias("w"), (F.col("p_partkey") % 90 - 10).cast("int").alias("preference"))
    score = F.col("w") * F.col("w") * 64 + F.greatest(F.least(F.col("preference"), F.lit(63)), F.lit(0))
    best = entries.groupBy("icon").agg(F.max(F.struct(score.alias("score"), (-F.col("seq")).alias("s"), "w")).alias("b"))
    return best.select("icon", (-F.col("b.s")).alias("seq"), "b.w", F.col("b.score").cast("long").alias("score"))


def xmp_property(spark, sf):
    k = F.col("p_partkey")
    attribute = F.format_string('<x hdrgm:GainMapMax="%d.5" hdrgm:Gamma="%d"/>', k % 7, k % 3)
    element = F.format_string("<x><hdrgm:GainMapMax><rdf:Seq><rdf:li>%d</rdf:li><rdf:li>2</rdf:li><rdf:li>3.5</rdf:li></rdf:Seq></hdrgm:GainMapMax><hdrgm:Gamma>bad</hdrgm:Gamma></x>", k % 7)
    rows = X.table(spark, sf, "part").select("p_partkey", F.when(k % 2 == 0, attribute).otherwise(element).alias("xmp"))
    numbers = T.numbers_of(F.col("xmp"), "GainMapMax")
    gamma = T.numbers_of(F.col("xmp"), "Gamma")
    return rows.select("p_partkey", numbers[0].alias("r"), numbers[1].alias("g"), numbers[2].alias("b"), F.when(gamma[0] > 0, gamma[0]).alias("gamma"))


_CFG = (
    (1, '# a comment\r\nsort = newest\nhdr_white = 300\nhdr_white = 9000\ncache = "/tmp/a b"\n'),
    (2, "colour = red\n\n  streaming_mode =  on \nstreaming_mode = maybe\ncache_mode=small"),
    (3, ""),
    (4, "sort = a-z\nsort = z-a\n# sort = oldest\npersist_streams = on\nno equals sign"),
    (5, 'hdr_white = +90\nhdr_white = 50 \nprevent_sleep = "never"\nmemory_mode = a = b\ncache = ""'),
)


def _cfg(spark):
    return spark.createDataFrame([(k, v) for k, v in _CFG], "file int, content string")


def config_settings(spark, sf):
    return G.settings(_cfg(spark))


def config_warnings(spark, sf):
    return G.warnings(_cfg(spark))


def config_missing(spark, sf):
    return G.missing(_cfg(spark))


#: What holds by default, and what each file says, written out.
_PLAIN = {"cache": "", "cache_mode": "fast", "streaming_mode": "off", "persist_streams": "off", "memory_mode": "speed", "sort": "a-z", "prevent_sleep": "fullscreen", "hdr_white": "100"}
_SET = {
    1: {"sort": "newest", "hdr_white": "300", "cache": "/tmp/a b"},
    2: {"streaming_mode": "on", "cache_mode": "small"},
    3: {},
    4: {"sort": "z-a", "persist_streams": "on"},
    5: {"hdr_white": "50", "prevent_sleep": "never"},
}
_SAID = {1: ("sort", "hdr_white", "cache"), 2: ("streaming_mode", "cache_mode"), 3: (), 4: ("sort", "persist_streams"), 5: ("hdr_white", "prevent_sleep", "memory_mode", "cache")}
_WARNED = (
    (1, 4, 'hdr_white cannot be "9000"'), (2, 1, 'unknown key "colour"'), (2, 4, 'streaming_mode cannot be "maybe"'), (4, 5, 'expected key = value, found "no equals sign"'),
    (5, 1, 'hdr_white cannot be "+90"'), (5, 4, 'memory_mode cannot be "a = b"'),
)
_ALL_LINES = "".join(f"{k} ={' ' * bool(v)}{v}\n" for k, v in _PLAIN.items())


def config_completed(spark, sf):
    return G.completed(_cfg(spark))


def _values(rows, names):
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({names})"


def crc32_fold(spark, sf):
    return X.table(spark, sf, "customer").select("c_custkey", F.crc32(F.encode("c_name", "UTF-8")).alias("crc"))


def fnv1a(spark, sf):
    """Identity of short strings and the cache file name made of it."""
    rows = X.table(spark, sf, "customer").select("c_custkey", B.fnv1a(F.encode("c_mktsegment", "UTF-8")).alias("h"))
    return rows.select("c_custkey", F.col("h").cast("string").alias("fnv"))


def viewbox(spark, sf):
    k = F.col("p_partkey")
    svg = F.when(k % 5 == 0, F.lit("<svg>")).otherwise(F.format_string('<svg viewBox="%d, 0 %d 50">', k % 3, k % 100))
    box = T.view_box(svg)
    scale = F.least(800.0 / box[2], 600.0 / box[3])
    return X.table(spark, sf, "part").select("p_partkey", box[0].alias("left"), box[2].alias("width"), F.round(T.svg_axis(F.lit(800.0), box[2], box[0], scale, 1), 6).alias("offset"))


def tile_index(spark, sf):
    tiles = X.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).alias("image"), (F.col("o_orderkey") % 3).alias("level"), F.col("o_orderkey").alias("row"), F.lit(0).alias("column"), F.col("o_totalprice").cast("long").alias("bytes")
    )
    return S.tile_index(tiles)


def tile_headers(spark, sf):
    k = F.col("o_orderkey")
    heads = X.table(spark, sf, "orders").select("o_orderkey", (k % 3 + 5).alias("version"), F.when(k % 2 == 0, 1024).otherwise(512).alias("tile"), (k % 3 + 2).alias("channels"), (k % 4).alias("levels"), (k % 90).alias("table_at"), F.lit(100).alias("size"))
    return S.sound(heads)


def band_starts(spark, sf):
    """Every n-th restart starts a step."""
    return X.frames(spark, sf).where("frame % 2 = 0").select("image", "frame")


QUERIES = {
    "sniff": (sniff, f"SELECT id::BIGINT AS id, kind, name, kind <> 'Other' AS recognised FROM (VALUES {_HEADS_SQL}) t(id, kind, name) UNION ALL SELECT doc_id + 1000, 'Other', NULL, false FROM documents"),
    "header_sizes": (header_sizes, "SELECT * FROM (VALUES (2::BIGINT, 500, 300), (6, 500, 160), (7, 1600, 1200)) t(id, width, height)"),
    "exif_orientation": (
        exif_orientation,
        "SELECT (10 * i + v)::BIGINT AS id, CASE WHEN v BETWEEN 1 AND 8 THEN v ELSE 1 END::INT AS orientation FROM range(2) a(i), range(10) b(v) UNION ALL SELECT id, 1 FROM range(100, 103) t(id)",
    ),
    "icns_mask": (icns_mask, "SELECT k AS id, k + 4 AS icon, CASE WHEN k % 4 = 0 THEN k + 1 WHEN k % 3 <> 0 THEN k END AS mask FROM range(1, 21) t(k)"),
    "icon_largest": (
        icon_largest,
        """WITH e AS (SELECT p_partkey % 40 AS icon, p_partkey AS seq, p_size * 4 AS w, p_size * 4 * p_size * 4 * 64 + greatest(least(p_partkey % 90 - 10, 63), 0) AS score FROM part)
        SELECT icon, seq, w, score::BIGINT AS score FROM e QUALIFY row_number() OVER (PARTITION BY icon ORDER BY score DESC, seq) = 1""",
    ),
    "xmp_property": (
        xmp_property,
        """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 + 0.5 ELSE p_partkey % 7 END::DOUBLE AS r, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 + 0.5 ELSE 2 END::DOUBLE AS g,
        CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 + 0.5 ELSE 3.5 END::DOUBLE AS b, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN p_partkey % 3 END::DOUBLE AS gamma FROM part""",
    ),
    "config_settings": (config_settings, _values([f"({f}, '{k}', '{s.get(k, d)}')" for f, s in _SET.items() for k, d in _PLAIN.items()], "file, key, value")),
    "config_warnings": (
        config_warnings,
        _values([f"({f}, {n}, '{w}')" for f, n, w in _WARNED], "file, line_no, warning"),
    ),
    "config_completed": (
        config_completed,
        "SELECT k AS file, c || CASE WHEN c <> '' AND NOT suffix(c, chr(10)) THEN chr(10) ELSE '' END || a AS content FROM (VALUES "
        + ", ".join("({}, {}, {})".format(k, *("replace(replace('{}', '~n', chr(10)), '~r', chr(13))".format(t.replace("\r", "~r").replace("\n", "~n")) for t in (c, "".join(x + "\n" for x in _ALL_LINES.splitlines() if x.split(" =")[0] not in _SAID[k])))) for k, c in _CFG)
        + ") t(k, c, a)",
    ),
    "config_missing": (config_missing, _values([f"({f}, '{k}', '{d}')" for f, said in _SAID.items() for k, d in _PLAIN.items() if k not in said], "file, key, value")),
    "crc32": (crc32_fold, None),
    "fnv1a": (
        fnv1a,
        """WITH RECURSIVE names AS (SELECT DISTINCT c_mktsegment AS s FROM customer),
        f AS (SELECT s, 0 AS i, 14695981039346656037::UHUGEINT AS h FROM names
          UNION ALL SELECT s, i + 1, (xor(h, ascii(substr(s, i + 1, 1))::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM f WHERE i < length(s))
        SELECT c_custkey, h::VARCHAR AS fnv FROM customer JOIN f ON f.s = c_mktsegment AND f.i = length(f.s)""",
    ),
    "viewbox": (
        viewbox,
        """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 100 > 0 THEN p_partkey % 3 END::DOUBLE AS l, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 100 > 0 THEN p_partkey % 100 END::DOUBLE AS w FROM part)
        SELECT p_partkey, l AS "left", w AS width, round((800 - w * least(800 / w, 12)) / 2 - l * least(800 / w, 12), 6) + 0 AS "offset" FROM t""",
    ),
    "tile_index": (
        tile_index,
        """WITH t AS (SELECT o_custkey % 100 AS image, o_orderkey % 3 AS level, o_orderkey AS "row", 0 AS "column", trunc(o_totalprice)::BIGINT AS bytes FROM orders)
        SELECT *, coalesce(sum(bytes) OVER (PARTITION BY image ORDER BY level, "row", "column" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM t""",
    ),
    "tile_headers": (
        tile_headers,
        """SELECT o_orderkey, 6::BIGINT AS version, 1024 AS tile, o_orderkey % 3 + 2 AS channels, o_orderkey % 4 AS levels, o_orderkey % 90 AS table_at, 100 AS size FROM orders
        WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 AND o_orderkey % 4 > 0 AND o_orderkey % 90 + o_orderkey % 4 * 16 <= 100""",
    ),
    "band_starts": (band_starts, f"WITH {FR} SELECT image, frame FROM fr WHERE frame % 2 = 0"),
}
