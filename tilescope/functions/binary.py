"""Bytes of files: magic numbers, integers, header fields, as Column expressions over BINARY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(data: Column, at: Column | int, n: int) -> Column:
    return F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(n))


def big(data: Column, at: Column | int, n: int) -> Column:
    """Unsigned big-endian; beyond the data 0."""
    raw = part(data, at, n)
    return F.when(F.octet_length(raw) == n, F.conv(F.hex(raw), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def little(data: Column, at: Column | int, n: int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return sum((big(data, at + k, 1) * (1 << (8 * k)) for k in range(1, n)), big(data, at, 1))


def starts(data: Column, hex_bytes: str, at: int = 0) -> Column:
    return F.hex(part(data, at, len(hex_bytes) // 2)) == hex_bytes


#: Magic bytes in the order in which they are tried.
MAGIC = (("Jpeg", "FFD8FF"), ("Png", "89504E470D0A1A0A"))


def sniff(data: Column) -> Column:
    """Format from leading bytes; the first rule that holds decides."""
    rule = F.when(F.lit(False), "")
    for name, magic in MAGIC:
        rule = rule.when(starts(data, magic), name)
    return (
        rule.when(starts(data, "52494646") & starts(data, "57454250", 8), "WebP")
        .when(starts(data, "FF0A") | starts(data, "0000000C4A584C200D0A870A"), "Jxl")
        .when(starts(data, "47494638"), "Gif")
        .when(starts(data, "424D"), "Bmp")
        .when(starts(data, "00000100") & (little(data, 4, 2) > 0), "Ico")
        .when(starts(data, "69636E73"), "Icns")
        .when(starts(data, "49492A00") | starts(data, "4D4D002A"), "Tiff")
        .when(starts(data, "66747970", 4), "Heif")
        .when(starts(data, "25504446"), "Pdf")
        .when(starts(data, "3C3F786D6C") | starts(data, "3C737667"), "Svg")
        .otherwise("Other")
    )


#: Names shown for formats.
FORMAT_NAMES = {
    "Jpeg": "JPEG", "Png": "PNG", "WebP": "WEBP", "Jxl": "JXL", "Gif": "GIF", "Bmp": "BMP", "Ico": "ICO",
    "Icns": "ICNS", "Tiff": "TIFF", "Heif": "HEIF", "Svg": "SVG", "Pdf": "PDF",
}


def format_name(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in FORMAT_NAMES.items():
        out = out.when(kind == k, v)
    return out


def scales_cheaply(kind: Column) -> Column:
    return kind.isin("Jpeg", "Svg", "Pdf")


def scalable(kind: Column) -> Column:
    return kind.isin("Svg", "Pdf")


def can_save_orientation(kind: Column) -> Column:
    return kind.isin("Jpeg", "Png", "WebP", "Tiff")


def png_size(data: Column) -> Column:
    return F.struct(big(data, 16, 4).cast("int").alias("width"), big(data, 20, 4).cast("int").alias("height"))


def bmp_size(data: Column) -> Column:
    """Core headers have 16-bit sides; in others a negative height is a top-down image."""
    core = little(data, 14, 4) == 12
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)
    return F.struct(
        F.when(core, little(data, 18, 2)).otherwise(signed(little(data, 18, 4))).cast("int").alias("width"),
        F.when(core, little(data, 20, 2)).otherwise(F.abs(signed(little(data, 22, 4)))).cast("int").alias("height"),
    )


def gif_size(data: Column) -> Column:
    return F.struct(little(data, 6, 2).cast("int").alias("width"), little(data, 8, 2).cast("int").alias("height"))


def fnv1a(data: Column) -> Column:
    """64-bit FNV-1a as a decimal; bytes one after the other, modulo 2^64 in decimal arithmetic."""
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    prime_low, prime_high = 435, 1 << 40  # prime = 2^40 + 435
    wide = lambda c: c.cast("decimal(38,0)")
    top = F.lit(1 << 24).cast("decimal(38,0)")
    def step(h: Column, k: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("int")
        low = wide(h % F.lit(256).cast("decimal(38,0)")).cast("int")
        mixed = wide(h - wide(low) + wide(low.bitwiseXOR(byte)))
        product = wide(mixed * F.lit(prime_low).cast("decimal(10,0)")) + wide(wide(mixed % top) * F.lit(prime_high).cast("decimal(14,0)"))
        return wide(wide(product) % two64)
    basis = F.lit("14695981039346656037").cast("decimal(38,0)")
    at = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, basis, step)
