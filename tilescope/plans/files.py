"""Files built byte by byte from the tables, and what is read from their headers or written into them.

A file is an expression of hexadecimal digits over a row, so every table row gives a file of
its own, and the SQL says what must be read from it without looking at bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary as B
from ..sources import fixtures as X
from ..sources import probes as P
from ..sources import reorient as R


def be(value: Column | int, size: int) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.lpad(F.right(F.hex(value.cast("long")), F.lit(2 * size)), 2 * size, "0")


def le(value: Column | int, size: int) -> Column:
    digits = be(value, size)
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def text(said: str | bytes) -> Column:
    return F.lit((said.encode("latin-1") if isinstance(said, str) else said).hex().upper())


def zeros(size: int) -> Column:
    return F.lit("00" * size)


def half_length(digits: Column) -> Column:
    return F.expr("1") * F.length(digits) / 2


def tiff(orientation: Column, order: str = "II") -> Column:
    n = le if order == "II" else be
    return F.concat(text(order), n(42, 2), n(8, 4), n(1, 2), n(0x0112, 2), n(3, 2), n(1, 4), n(orientation, 2), n(0, 2), n(0, 4))


def png_chunk(name: str, body: Column) -> Column:
    return F.concat(be(half_length(body), 4), text(name), body, zeros(4))


def segment(marker: int, body: Column) -> Column:
    return F.concat(F.lit("FF"), be(marker, 1), be(half_length(body) + 2, 2), body)


def riff_chunk(name: str, body: Column) -> Column:
    return F.concat(text(name), le(half_length(body), 4), body, F.when(half_length(body) % 2 == 1, "00").otherwise(""))


def box(name: str, body: Column) -> Column:
    return F.concat(be(half_length(body) + 8, 4), text(name), body)


def when(rule: Column, part: Column) -> Column:
    return F.when(rule, part).otherwise("")


def part(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return X.table(spark, sf, "part").select(k.alias("k"), (k % 9000 + 1).alias("w"), (F.col("p_size") * 7 + k % 5).alias("h"), (k % 9).alias("o"))


#: The same in SQL; ``o`` out of 1 to 8 counts as 1.
_PART = "p AS (SELECT p_partkey AS k, p_partkey % 9000 + 1 AS w, p_size * 7 + p_partkey % 5 AS h, p_partkey % 9 AS o FROM part)"
_TURN = "CASE WHEN turn >= 5 THEN h ELSE w END::INT AS width, CASE WHEN turn >= 5 THEN w ELSE h END::INT AS height, turn::INT AS orientation"
def k_() -> Column:
    return F.col("k")


def w_() -> Column:
    return F.col("w")


def h_() -> Column:
    return F.col("h")


def o_() -> Column:
    return F.col("o")


def files(rows: DataFrame, kind: str, digits: Column, *more: str) -> DataFrame:
    return rows.select(k_().alias("id"), F.lit(kind).alias("kind"), F.unhex(digits).alias("content"), *more)


def png_file() -> Column:
    """eXIf in every third file, cICP of several transfers in others; a chunk behind the image data does not count."""
    header = png_chunk("IHDR", F.concat(be(w_(), 4), be(h_(), 4), F.lit("0806000000")))
    transfer = F.element_at(F.array(*map(F.lit, (1, 16, 18, 8))), (k_() % 4 + 1).cast("int"))
    early = F.concat(when(k_() % 3 == 0, png_chunk("eXIf", tiff(o_()))), when(k_() % 5 == 0, png_chunk("cICP", F.concat(be(9, 1), be(transfer, 1), F.lit("0001")))))
    return F.concat(text(P.PNG_MAGIC), header, early, png_chunk("IDAT", text("data")), when(k_() % 3 == 1, png_chunk("eXIf", tiff(o_()))), png_chunk("IEND", F.lit("")))


def probe_png(spark, sf):
    return P.probe(files(part(spark, sf), "Png", png_file()))


def jpeg_file() -> Column:
    """JFIF, XMP before Exif in APP1, fill bytes, baseline or progressive."""
    exif = segment(0xE1, F.concat(text("Exif\0\0"), F.when(k_() % 2 == 0, tiff(o_())).otherwise(tiff(o_(), "MM"))))
    frame = lambda marker: segment(marker, F.concat(F.lit("08"), be(h_(), 2), be(w_(), 2), F.lit("03"), F.lit("012200021101031101")))
    sized = F.when(k_() % 4 == 1, frame(0xC2)).otherwise(frame(0xC0))
    return F.concat(
        F.lit("FFD8"), segment(0xE0, text("JFIF\0\1\1")), when(k_() % 5 == 0, segment(0xE1, text(P.XMP_HEAD + b"<x/>"))), when(k_() % 3 == 0, exif), when(k_() % 7 == 0, F.lit("FFFF")),
        segment(0xC4, zeros(4)), sized, segment(0xDA, F.lit("03010002110311003F00")), text("scan"), F.lit("FFD9"),
    )


def probe_jpeg(spark, sf):
    return P.probe(files(part(spark, sf), "Jpeg", jpeg_file()))


def webp_file() -> Column:
    """Extended (with an animation in some), lossy and lossless files; EXIF behind the image."""
    flags = F.when(k_() % 10 == 0, 2).otherwise(0) + F.when(o_() > 0, 8).otherwise(0)
    extended = F.concat(riff_chunk("VP8X", F.concat(be(flags, 1), zeros(3), le(w_() - 1, 3), le(h_() - 1, 3))), riff_chunk("VP8L", text("imag")), when(o_() > 0, riff_chunk("EXIF", tiff(o_()))))
    lossy = riff_chunk("VP8 ", F.concat(zeros(3), F.lit("9D012A"), le(w_(), 2), le(h_(), 2), text("odd")))
    lossless = riff_chunk("VP8L", F.concat(F.lit("2F"), le((w_() - 1) + (h_() - 1) * (1 << 14) + F.when(k_() % 2 == 0, 1 << 28).otherwise(0), 4), text("data")))
    body = F.concat(text("WEBP"), F.when(k_() % 5 < 3, extended).when(k_() % 5 == 3, lossy).otherwise(lossless))
    return F.concat(text("RIFF"), le(half_length(body), 4), body)


def probe_webp(spark, sf):
    return P.probe(files(part(spark, sf), "WebP", webp_file()))


def bits(value: Column | int, size: int) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.right(F.lpad(F.bin(value.cast("long")), 64, "0"), F.lit(size))


def jxl_side(value: Column) -> Column:
    """A side less one, in the least of 13, 18 and 30 bits that holds it, behind two bits that name the choice."""
    way = lambda choice, size: F.concat(bits(value, size), bits(choice, 2))
    return F.when(value < 1 << 13, way(1, 13)).when(value < 1 << 18, way(2, 18)).otherwise(way(3, 30))


def jxl_bits(*fields: tuple[Column | int, int] | Column, size: int = 8) -> Column:
    """Numbers of so many bits each, or binary digits, the first one lowest, as ``size`` bytes, a multiple of 8."""
    binary = [field if isinstance(field, Column) else bits(*field) for field in reversed(fields)]
    whole = F.lpad(F.concat(*binary), 8 * size, "0")
    digits = F.concat(*[F.lpad(F.conv(F.substring(whole, 8 * k + 1, 64), 2, 16), 16, "0") for k in range(0, size, 8)])
    # pairs of digits turn round; a substring for each would compute all digits anew
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def jxl_file() -> Column:
    """Sides by a ratio or in full, bare or in a box; orientation and a transfer in half of the files, a gain map in a few."""
    eight = k_() % 32
    ratio = k_() % 7 + 1
    plain = jxl_bits((1, 1), (eight, 5), (ratio, 3), (1, 1))
    said = jxl_bits(
        (0, 1), jxl_side(h_() + 99), (0, 3), jxl_side(w_() - 1), (0, 1), (1, 1), (F.greatest(o_(), F.lit(1)) - 1, 3), (0, 3), (0, 3), (1, 1), (0, 2), (1, 1), (0, 2), (0, 2), (1, 2), (1, 2), (0, 1), (2, 2), (k_() % 3 + 13, 4),
        size=16,
    )
    stream = F.concat(F.lit("FF0A"), F.when(k_() % 2 == 0, plain).otherwise(said))
    boxed = F.concat(text(b"\0\0\0\x0cJXL \r\n\x87\n"), when(k_() % 9 == 0, box("jhgm", zeros(4))), box("jxlc", stream))
    return F.when(k_() % 3 == 0, boxed).otherwise(stream)


def probe_jxl(spark, sf):
    return P.probe(files(part(spark, sf), "Jxl", jxl_file()))


def bmp_file() -> Column:
    """Core and full headers of several depths, bottom up and top down, bit masks, run lengths; some that make no sense."""
    depth = F.element_at(F.array(*map(F.lit, (1, 4, 8, 16, 24, 32))), (k_() % 6 + 1).cast("int"))
    core = F.concat(le(12, 4), le(w_(), 2), le(h_(), 2), le(1, 2), le(depth, 2))
    high = F.when(k_() % 4 == 1, F.lit(1 << 32) - h_()).otherwise(h_())
    scheme = F.when((k_() % 5 == 2) & depth.isin(16, 32), 3).when((k_() % 5 == 3) & (depth == 8), 1).when((k_() % 5 == 3) & (depth == 4), 2).otherwise(0)
    info = F.concat(le(40, 4), le(w_(), 4), le(high, 4), le(1, 2), le(depth, 2), le(scheme, 4), zeros(12), le(k_() % 3, 4), zeros(4))
    masks = when(scheme == 3, F.concat(le(0xF800, 4), le(0x7E0, 4), le(0x1F, 4)))
    head = F.when(k_() % 7 == 0, core).otherwise(F.concat(info, masks))
    return F.concat(text("BM"), zeros(8), le(0, 4), head, zeros(1100))


def bmp_headers(spark, sf):
    return P.bitmaps(files(part(spark, sf), "Bmp", bmp_file()))


_BMP = f"""WITH {_PART}, d AS (SELECT *, ([1, 4, 8, 16, 24, 32])[k % 6 + 1] AS depth, k % 7 = 0 AS core, k % 4 = 1 AND k % 7 <> 0 AS down FROM p),
s AS (SELECT *, CASE WHEN core THEN 0 WHEN k % 5 = 2 AND depth IN (16, 32) THEN 3 WHEN k % 5 = 3 AND depth = 8 THEN 1 WHEN k % 5 = 3 AND depth = 4 THEN 2 ELSE 0 END AS scheme FROM d),
l AS (SELECT *, CASE WHEN scheme = 1 THEN 'rle8' WHEN scheme = 2 THEN 'rle4' WHEN scheme = 3 THEN CASE depth WHEN 16 THEN 'masked16' ELSE 'masked32' END
  WHEN depth <= 8 THEN 'indexed' WHEN depth = 16 THEN 'masked16' WHEN depth = 24 THEN 'bgr' ELSE 'bgra' END AS layout FROM s WHERE h > 0),
c AS (SELECT *, CASE WHEN depth > 8 THEN 0 WHEN NOT core AND k % 3 BETWEEN 1 AND (1 << depth) - 1 THEN k % 3 ELSE 1 << depth END AS palette FROM l WHERE NOT (layout IN ('rle8', 'rle4') AND down))
SELECT k AS id, w::INT AS width, h::INT AS height, NOT down AS bottom_up, depth::INT AS depth, layout, palette::INT AS palette,
  (14 + CASE WHEN core THEN 12 + palette * 3 ELSE 40 + palette * 4 + CASE WHEN scheme = 3 THEN 12 ELSE 0 END END)::BIGINT AS pixels_at,
  (CASE WHEN scheme = 3 THEN 63488 WHEN layout = 'masked16' THEN 31744 WHEN layout = 'bgra' THEN 16711680 ELSE 0 END)::BIGINT AS red,
  (CASE WHEN scheme = 3 THEN 2016 WHEN layout = 'masked16' THEN 992 WHEN layout = 'bgra' THEN 65280 ELSE 0 END)::BIGINT AS green,
  (CASE WHEN scheme = 3 THEN 31 WHEN layout = 'masked16' THEN 31 WHEN layout = 'bgra' THEN 255 ELSE 0 END)::BIGINT AS blue,
  (CASE WHEN layout = 'bgra' THEN 4278190080 ELSE 0 END)::BIGINT AS alpha FROM c"""


def ico_file() -> Column:
    """Three entries: a bitmap whose height counts its mask, a PNG, and one that reaches past the end."""
    dib = F.concat(le(40, 4), le(k_() % 60 + 1, 4), le((k_() % 50 + 1) * 2, 4), le(1, 2), le(24, 2), zeros(24))
    png = F.concat(text(P.PNG_MAGIC), zeros(8), be(k_() % 40 + 10, 4), be(k_() % 40 + 10, 4))
    entry = lambda size, at: F.concat(zeros(8), le(size, 4), le(at, 4))
    return F.concat(F.lit("000001000300"), entry(40, 54), entry(24, 94), entry(99, 94), dib, png)


def icon_ico(spark, sf):
    return P.largest_icons(files(part(spark, sf), "Ico", ico_file()))


def icns_file() -> Column:
    """A packed icon with two masks, a larger PNG in some files, an entry that is neither; chunks past the end are not read."""
    chunk = lambda name, body: F.concat(text(name), be(half_length(body) + 8, 4), body)
    png = F.concat(text(P.PNG_MAGIC), zeros(8), be(k_() % 100 + 1, 4), be(k_() % 100 + 1, 4))
    packed = F.when(k_() % 2 == 0, chunk("il32", text("packed pixels"))).otherwise(chunk("it32", text("\0\0\0\0planes")))
    mask = F.when(k_() % 2 == 0, F.concat(chunk("l8mk", text("mm")), chunk("l8mk", text("mask")))).otherwise("")
    body = F.concat(chunk("TOC ", zeros(2)), packed, chunk("ic07", text("neither")), when(k_() % 3 == 0, chunk("ic08", png)), mask)
    return F.concat(text("icns"), be(half_length(body) + 8, 4), body, text("ic09"), be(4000, 4))


def icon_icns(spark, sf):
    return P.largest_icons(files(part(spark, sf), "Icns", icns_file()))


def heif_file() -> Column:
    """The primary item's colour property, another item's, and a gain map by an item or by an auxiliary property."""
    transfer = F.element_at(F.array(*map(F.lit, (1, 16, 18, 8))), (k_() % 4 + 1).cast("int"))
    colour = lambda t: box("colr", F.concat(text("nclx"), be(9, 2), be(t, 2), be(9, 2), F.lit("80")))
    size = box("ispe", F.concat(zeros(4), be(w_(), 4), be(h_(), 4)))
    held = F.concat(size, colour(F.lit(16)), colour(transfer), when(k_() % 5 == 0, box("auxC", F.concat(zeros(4), text(P.APPLE_GAIN_MAP + b"\0")))))
    wide = k_() % 2 == 0  # identifiers of 32 bits, numbers of 15
    links = F.when(wide, F.concat(F.lit("01000001"), be(2, 4), be(7, 4), F.lit("01"), be(0x8002, 2), be(9, 4), F.lit("02"), be(1, 2), be(0x8003, 2)))
    links = links.otherwise(F.concat(F.lit("00000000"), be(2, 4), be(7, 2), F.lit("01"), be(0x82, 1), be(9, 2), F.lit("02"), be(1, 1), be(0x83, 1)))
    primary = F.when(wide, F.concat(F.lit("01000000"), be(9, 4))).otherwise(F.concat(zeros(4), be(9, 2)))
    item = lambda name: box("infe", F.concat(F.lit("02000000"), be(5, 2), zeros(2), text(name)))
    items = F.concat(zeros(4), be(2, 2), item("hvc1"), F.when(k_() % 7 == 0, item("tmap")).otherwise(item("Exif")))
    meta = F.concat(zeros(4), box("pitm", primary), box("iinf", items), box("iprp", F.concat(box("ipco", held), box("ipma", links))))
    return F.concat(box("ftyp", text("heicmif1")), F.when(k_() % 3 == 0, F.concat(be(1, 4), text("meta"), be(half_length(meta) + 16, 8), meta)).otherwise(box("meta", meta)), text("beyond"))


def heif_colour(spark, sf):
    return P.heif_colours(files(part(spark, sf), "Heif", heif_file()))


def probe_heif(spark, sf):
    return P.probe(files(part(spark, sf), "Heif", heif_file()))


def fractions(*pairs: tuple[Column | int, int]) -> Column:
    return F.concat(*[F.concat(be(F.lit(top) if isinstance(top, int) else top, 4), be(bottom, 4)) for top, bottom in pairs])


def gain_metadata() -> Column:
    """The binary form: one channel or three; a gamma of 0 in a few, which no gain map has."""
    gamma = F.when(k_() % 11 == 0, 0).otherwise(k_() % 3 + 1)
    channel = lambda n: fractions((F.lit(-n) - k_() % 4, 2), (k_() % 5 + n, 4), (gamma, 1), (1, 64), (F.lit(-1), 64))
    heads = fractions((0, 1), (k_() % 6, 2))
    one, three = channel(1), F.concat(channel(1), channel(2), channel(3))
    return F.concat(zeros(4), F.when(k_() % 2 == 0, F.concat(F.lit("40"), heads, one)).otherwise(F.concat(F.lit("80"), heads, three)))


XMP = b'<x hdrgm:Version="1.0" hdrgm:HDRCapacityMax="2.5" hdrgm:Gamma=\'1.5\'><hdrgm:GainMapMax><rdf:Seq><rdf:li>1</rdf:li><rdf:li> 2</rdf:li><rdf:li>+3.5</rdf:li></rdf:Seq></hdrgm:GainMapMax></x>'


def gain_jpeg() -> Column:
    """A primary image with an index of three entries: itself, one that lies beyond the end, and the gain map."""
    said = F.when(k_() % 4 == 3, segment(0xE1, text(P.XMP_HEAD + XMP))).otherwise(segment(0xE2, F.concat(text(P.ISO_HEAD), gain_metadata())))
    second = F.concat(F.lit("FFD8"), said, F.lit("FFDA0008"), text("scan"))
    entry = lambda size, at: F.concat(zeros(4), le(size, 4), le(at, 4), zeros(4))
    # offsets count from the byte behind the signature: 10 bytes into the file; the first image ends 100 bytes in
    index = F.concat(text("MPF\0II*\0"), le(8, 4), le(1, 2), le(0xB002, 2), le(7, 2), le(48, 4), le(26, 4), le(0, 4), entry(100, 0), entry(50, 9_000_000), entry(half_length(second), 90))
    return F.concat(F.lit("FFD8"), segment(0xE2, index), F.lit("FFDA000C"), zeros(10), F.lit("FFD9"), second)


def gain_maps(spark, sf):
    return P.gain_maps(files(part(spark, sf), "Jpeg", gain_jpeg()))


def further_images(spark, sf):
    return P.further_images(files(part(spark, sf), "Jpeg", gain_jpeg()))


def probe_gain(spark, sf):
    """A JPEG is HDR if one of its images says that it is a gain map."""
    sized = F.concat(F.lit("FFD8"), segment(0xC0, F.concat(F.lit("08"), be(h_(), 2), be(w_(), 2), F.lit("01"), F.lit("011100"))), F.substring(gain_jpeg(), 5, 1_000_000))
    # the index stands 13 + 2 bytes later, and so does all that its offsets count from
    return P.probe(files(part(spark, sf), "Jpeg", sized))


def gain_jxl(spark, sf):
    """The same metadata in a box of a JPEG XL file, whose encoding says sRGB or not."""
    said = gain_metadata()
    body = F.concat(F.lit("00"), be(half_length(said), 2), said, F.lit("02"), be(k_() % 2, 1), F.lit("00"), be(3, 4), text("icc"), text("image"))
    return P.gain_maps(files(part(spark, sf), "Jxl", F.concat(text(b"\0\0\0\x0cJXL \r\n\x87\n"), box("jhgm", body))))


_GAIN = "CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END::INT AS channels, (-1 - k % 4) / 2.0::DOUBLE AS low, (k % 5 + 1) / 4.0::DOUBLE AS high, (k % 3 + 1)::DOUBLE AS gamma, 1 / 64.0::DOUBLE AS base_offset, -1 / 64.0::DOUBLE AS other_offset, 0::DOUBLE AS base_headroom, k % 6 / 2.0::DOUBLE AS other_headroom, k % 2 = 0 AS base_colours"


def restart_jpeg() -> Column:
    """Baseline files with a restart interval, stuffed zeros and fill bytes in the scan; one restart too few in some."""
    mcus = lambda n: F.ceil(n / 16)
    per, rows = mcus(w_() % 200 + 1), mcus(h_() % 90 + 1)
    interval = F.when(k_() % 3 == 0, per).when(k_() % 3 == 1, per * 2).otherwise(F.ceil(per / 2))
    count = F.ceil(per * rows / interval) - F.when(k_() % 10 == 0, 1).otherwise(0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(0))), lambda i: F.concat(F.lit("41FF0042FFFFD"), F.pmod(i - 1, F.lit(8)).cast("string")))
    scan = F.concat(F.when(count > 1, F.array_join(runs, "")).otherwise(""), F.lit("43FF0044"))
    frame = F.concat(F.lit("08"), be(h_() % 90 + 1, 2), be(w_() % 200 + 1, 2), F.lit("03"), F.lit("012200021100031100"))
    return F.concat(F.lit("FFD8"), segment(0xC0, frame), segment(0xDD, be(interval, 2)), segment(0xDA, F.lit("03010002110311003F00")), scan, F.lit("FFD9"))


def restart_steps(spark, sf):
    return P.restart_steps(files(part(spark, sf), "Jpeg", restart_jpeg()))


def restart_adopted(spark, sf):
    """Starts that were kept for the same files; those of every seventh file are out of order."""
    rows = files(part(spark, sf), "Jpeg", restart_jpeg())
    kept = P.restart_steps(rows).groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    kept = kept.withColumn("starts", F.when(F.col("id") % 7 == 0, F.concat(F.slice("starts", 1, 1), F.transform("starts", lambda _: F.lit(1).cast("long")))).otherwise(F.col("starts")))
    return P.restart_steps(rows.join(kept, "id"), kept=True)


#: per: units a row, n: rows of units, i: interval, s: rows of units a step.  A scan starts 41 bytes in; a run has 7 bytes with its marker.
_STEPS = f"""WITH {_PART}, a AS (SELECT k, w % 200 + 1 AS w, h % 90 + 1 AS h FROM p),
b AS (SELECT k, h, (w + 15) // 16 AS per, (h + 15) // 16 AS n FROM a), c AS (SELECT *, CASE k % 3 WHEN 0 THEN per WHEN 1 THEN per * 2 ELSE (per + 1) // 2 END AS i FROM b),
d AS (SELECT *, i // gcd(i, per) AS s, (per * n + i - 1) // i AS runs FROM c), e AS (SELECT *, s * per // i AS each, (n + s - 1) // s AS steps FROM d WHERE k % 10 <> 0 OR runs = 1),
f AS (SELECT k AS id, q::INT AS step, (41 + q * each * 7)::BIGINT AS at, CASE WHEN q + 1 < steps THEN 41 + (q + 1) * each * 7 - 2 ELSE 41 + (runs - 1) * 7 + 4 END::BIGINT AS ends, (s * 16)::INT AS step_rows, 1 AS margin
  FROM e, range(8) t(q) WHERE q < steps AND s * 16 <= 1024)"""


def _saved(spark, sf):
    """Orientation k % 8 + 1 saved into files of the four kinds; 1 saved into those again."""
    rows = part(spark, sf)
    wanted = (k_() % 8 + 1).cast("int").alias("orientation")
    directory = F.concat(text("MM\0*"), be(8, 4), be(2, 2), be(0x0100, 2), be(4, 2), be(1, 4), be(w_(), 4), be(0x0117, 2), be(4, 2), be(1, 4), zeros(4), be(0, 4), text("strips"))
    every = {"Png": png_file(), "Jpeg": jpeg_file(), "WebP": webp_file(), "Tiff": directory, "Bmp": F.lit("424D")}
    first = None
    for turn, (kind, digits) in enumerate(every.items()):
        some = rows.select((k_() * 8 + turn).alias("id"), F.lit(kind).alias("kind"), F.unhex(digits).alias("content"), wanted)
        first = some if first is None else first.unionByName(some)
    return first


def orientation_saved(spark, sf):
    """What the changed files say, whether they could be written in place, and whether saving 1 again gives back what held no orientation."""
    first = _saved(spark, sf)
    once = R.save_orientation(first).select("id", "content", "in_place", "error").join(first.select("id", "kind", F.col("content").alias("before"), "orientation"), "id")
    again = R.save_orientation(once.where("error is null").select("id", "kind", "content", F.lit(1).alias("orientation"))).select("id", F.col("content").alias("back"))
    said = P.probe(once.where("kind <> 'Tiff'").select("id", "kind", "content")).select("id", F.col("orientation").alias("shown"))
    tiffs = P.by_file(once.where("kind = 'Tiff'").select("id", "content"), "shown int", lambda data, _: iter([(P.exif_orientation(data),)]))
    out = once.join(said.unionByName(tiffs), "id", "left").join(again, "id", "left")
    return out.select("id", "shown", "in_place", "error", (F.crc32("back") == F.crc32("before")).alias("restored"))


#: Sides of a JPEG XL file whose ratio is named: 1:1, 6:5, 4:3, 3:2, 16:9, 5:4, 2:1.
_JXL = f"""WITH {_PART}, a AS (SELECT *, (k % 32 + 1) * 8 AS h8, k % 7 + 1 AS r FROM p),
b AS (SELECT k, CASE WHEN k % 2 = 0 THEN h8 * ([1, 12, 4, 3, 16, 5, 2])[r] // ([1, 10, 3, 2, 9, 4, 1])[r] ELSE w END AS w, CASE WHEN k % 2 = 0 THEN h8 ELSE h + 100 END AS h,
  CASE WHEN k % 2 = 1 THEN greatest(o, 1) ELSE 1 END AS turn, (k % 2 = 1 AND k % 3 + 15 IN (16, 18)) OR k % 9 = 0 AS hdr FROM a) SELECT k AS id, {_TURN}, hdr FROM b"""

QUERIES = {
    "probe_png": (probe_png, f"WITH {_PART}, t AS (SELECT *, CASE WHEN k % 3 = 0 THEN greatest(o, 1) ELSE 1 END AS turn FROM p WHERE h > 0) SELECT k AS id, {_TURN}, k % 5 = 0 AND k % 4 IN (1, 2) AS hdr FROM t"),
    "probe_jpeg": (probe_jpeg, f"WITH {_PART}, t AS (SELECT *, CASE WHEN k % 3 = 0 THEN greatest(o, 1) ELSE 1 END AS turn FROM p WHERE h > 0) SELECT k AS id, {_TURN}, false AS hdr FROM t"),
    "probe_webp": (
        probe_webp,
        f"WITH {_PART}, t AS (SELECT *, CASE WHEN k % 5 < 3 THEN greatest(o, 1) ELSE 1 END AS turn FROM p WHERE NOT (k % 5 < 3 AND k % 10 = 0)) SELECT k AS id, {_TURN}, false AS hdr FROM t WHERE h > 0",
    ),
    "probe_jxl": (probe_jxl, _JXL),
    "probe_heif": (probe_heif, f"WITH {_PART} SELECT k AS id, w::INT AS width, h::INT AS height, 1 AS orientation, k % 5 = 0 OR k % 7 = 0 OR k % 4 IN (1, 2) AS hdr FROM p"),
    "probe_gain": (probe_gain, f"WITH {_PART} SELECT k AS id, w::INT AS width, h::INT AS height, 1 AS orientation, k % 4 = 3 OR k % 11 <> 0 AS hdr FROM p WHERE h > 0"),
    "bmp_headers": (bmp_headers, _BMP),
    "icon_ico": (
        icon_ico,
        f"""WITH {_PART}, e AS (SELECT k, k % 60 + 1 AS dw, k % 50 + 1 AS dh, k % 40 + 10 AS side FROM p), s AS (SELECT *, side * side * 64 + 32 > dw * dh * 64 + 24 AS png FROM e)
        SELECT k AS id, CASE WHEN png THEN side ELSE dw END::INT AS width, CASE WHEN png THEN side ELSE dh END::INT AS height, CASE WHEN png THEN 'png' ELSE 'dib' END AS payload,
          CASE WHEN png THEN 94 ELSE 54 END::BIGINT AS at, CASE WHEN png THEN 24 ELSE 40 END::BIGINT AS length, 0::BIGINT AS mask_at, 0::BIGINT AS mask_length FROM s""",
    ),
    "icon_icns": (
        icon_icns,
        f"""WITH {_PART}, e AS (SELECT k, CASE WHEN k % 2 = 0 THEN 32 ELSE 128 END AS side, CASE WHEN k % 3 = 0 THEN k % 100 + 1 ELSE 0 END AS png, CASE WHEN k % 2 = 0 THEN 13 ELSE 6 END AS n, CASE WHEN k % 2 = 0 THEN 0 ELSE 4 END AS skip FROM p),
        s AS (SELECT *, png * png * 64 + 3 > side * side * 64 + 1 AS win FROM e)
        SELECT k AS id, CASE WHEN win THEN png ELSE side END::INT AS width, CASE WHEN win THEN png ELSE side END::INT AS height, CASE WHEN win THEN 'png' ELSE 'packed' END AS payload,
          CASE WHEN win THEN 26 + n + skip + 15 + 8 ELSE 26 + skip END::BIGINT AS at, CASE WHEN win THEN 24 ELSE n END::BIGINT AS length,
          CASE WHEN NOT win AND k % 2 = 0 THEN 26 + n + 15 + CASE WHEN k % 3 = 0 THEN 32 ELSE 0 END + 10 + 8 ELSE 0 END::BIGINT AS mask_at, CASE WHEN NOT win AND k % 2 = 0 THEN 4 ELSE 0 END::BIGINT AS mask_length FROM s""",
    ),
    "heif_colour": (heif_colour, f"WITH {_PART} SELECT k AS id, (['srgb', 'pq', 'hlg', 'linear'])[k % 4 + 1] AS transfer, k % 5 = 0 OR k % 7 = 0 AS gain_map FROM p"),
    "gain_maps": (
        gain_maps,
        f"""WITH {_PART}, t AS (SELECT *, k % 4 = 3 AS xmp FROM p WHERE k % 4 = 3 OR k % 11 <> 0), m AS (SELECT k, xmp, {_GAIN} FROM t)
        SELECT k AS id, 100::BIGINT AS at, CASE WHEN xmp THEN {43 + len(XMP)} WHEN channels = 1 THEN 103 ELSE 183 END::BIGINT AS length, channels, CASE WHEN xmp THEN 0 ELSE low END AS low, CASE WHEN xmp THEN 1 ELSE high END AS high,
          CASE WHEN xmp THEN 1.5 ELSE gamma END AS gamma, base_offset, CASE WHEN xmp THEN 1 / 64.0::DOUBLE ELSE other_offset END AS other_offset, base_headroom,
          CASE WHEN xmp THEN 2.5 ELSE other_headroom END AS other_headroom, CASE WHEN xmp THEN false ELSE base_colours END AS base_colours FROM m""",
    ),
    "further_images": (further_images, f"WITH {_PART} SELECT k AS id, 0 AS seq, 100::BIGINT AS at, CASE WHEN k % 4 = 3 THEN {43 + len(XMP)} WHEN k % 2 = 0 THEN 103 ELSE 183 END::BIGINT AS length FROM p"),
    "gain_jxl": (
        gain_jxl,
        f"WITH {_PART}, t AS (SELECT * FROM p WHERE k % 11 <> 0) SELECT k AS id, (12 + 8 + 3 + CASE WHEN k % 2 = 0 THEN 61 ELSE 141 END + 3 + 4 + 3)::BIGINT AS at, 5::BIGINT AS length, {_GAIN} FROM t",
    ),
    "restart_steps": (restart_steps, f"{_STEPS} SELECT * FROM f"),
    "restart_adopted": (restart_adopted, f"{_STEPS} SELECT * FROM f WHERE id % 7 <> 0"),
    "orientation_saved": (
        orientation_saved,
        # had: a block is there, and minimal if its bytes are little-endian; PNGs with a late block say nothing of it
        f"""WITH {_PART}, t AS (SELECT k * 8 + q AS id, k, q, greatest(o, 1) AS o, k % 8 + 1 AS asked, q = 1 AND k % 2 = 1 AS big,
          CASE q WHEN 0 THEN k % 3 < 2 WHEN 1 THEN k % 3 = 0 WHEN 2 THEN k % 5 < 3 AND o > 0 ELSE false END AS had FROM p, range(5) r(q))
        SELECT id, CASE WHEN q = 4 OR (q = 2 AND k % 10 = 0) THEN NULL WHEN q = 0 AND k % 3 = 1 THEN 1 ELSE asked END::INT AS shown,
          CASE WHEN q = 4 THEN NULL WHEN had THEN asked <> 1 OR big ELSE asked = 1 END AS in_place,
          CASE WHEN q = 4 THEN 'this format keeps no orientation' END AS error, CASE WHEN q = 4 THEN NULL WHEN had THEN big AND o = 1 AND k % 9 = 1 ELSE true END AS restored FROM t""",
    ),
}
