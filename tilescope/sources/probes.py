"""What files say of themselves: sides, orientation and tone from headers, gain maps, and where rows start.

Headers are walks whose next step depends on the one before, so they are Python over
Arrow batches, a file a row.  Reads beyond the end of a file give 0, as a walk
that ends there needs them; a header that makes no sense gives no answer.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .headers import exif_orientation, iso_boxes_flat, jpeg_segments, riff_chunks

#: Transfer characteristics of H.273 that go beyond white, and what names a gain map.
HDR_TRANSFERS = {16: "pq", 18: "hlg"}
XMP_HEAD = b"http://ns.adobe.com/xap/1.0/\0"
ISO_HEAD = b"urn:iso:std:iso:ts:21496:-1\0"
MPF_HEAD = b"MPF\0"
APPLE_GAIN_MAP = b"urn:com:apple:photo:2020:aux:hdrgainmap"


def number(data: bytes, at: int, size: int, order: str = "big") -> int:
    return int.from_bytes(data[at : at + size], order) if at + size <= len(data) else 0


@dataclass
class Seen:
    """Sides as shown, after orientation."""

    width: int
    height: int
    orientation: int = 1
    hdr: bool = False


def shown(width: int, height: int, orientation: int = 1, hdr: bool = False) -> Seen:
    return Seen(height, width, orientation, hdr) if orientation >= 5 else Seen(width, height, orientation, hdr)


def png_chunk(data: bytes, name: bytes) -> bytes:
    """A chunk's content, of those before the image data."""
    at = 8
    while at + 12 <= len(data) and data[at + 4 : at + 8] != b"IDAT":
        size = number(data, at, 4)
        if size > len(data) - at - 12:
            break
        if data[at + 4 : at + 8] == name:
            return data[at + 8 : at + 8 + size]
        at += 12 + size
    return b""


def png(data: bytes) -> Seen | None:
    if len(data) < 24:
        return None
    width, height = struct.unpack_from(">ii", data, 16)
    exif, cicp = png_chunk(data, b"eXIf"), png_chunk(data, b"cICP")
    hdr = len(cicp) >= 2 and cicp[1] in HDR_TRANSFERS
    return shown(width, height, exif_orientation(exif) if exif else 1, hdr) if width > 0 and height > 0 else None


def jpeg_frame(data: bytes) -> tuple[int, bytes] | None:
    """The marker and content of the frame header."""
    for marker, at, size in jpeg_segments(data):
        code = int(marker, 16)
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            return code, data[at : at + size]
    return None


def jpeg(data: bytes) -> Seen | None:
    found = jpeg_frame(data)
    if found is None or len(found[1]) < 6:
        return None
    height, width = struct.unpack_from(">HH", found[1], 1)
    exif = next((data[at : at + n] for marker, at, n in jpeg_segments(data) if marker == "E1" and data[at : at + 6] == b"Exif\0\0"), b"")
    return shown(width, height, exif_orientation(exif), jpeg_gain_map(data) is not None) if width and height else None


def webp(data: bytes) -> Seen | None:
    """Of a still image; an animation gives no answer."""
    size = webp_size(data)
    if size is None or size[2]:
        return None
    orientation = 1
    for name, at, n in riff_chunks(data):
        if at + n > len(data):
            break
        if name == "EXIF":
            orientation = exif_orientation(data[at : at + n])
            break
    return shown(size[0], size[1], orientation)


def webp_size(data: bytes) -> tuple[int, int, bool, bool] | None:
    """Width, height, animated, alpha: of the extended header, or else of the lossy or lossless image."""
    body = data[12:] if data[:4] == b"RIFF" else data
    name, content = body[:4], body[8:]
    if name == b"VP8X" and len(content) >= 10:
        return 1 + number(content, 4, 3, "little"), 1 + number(content, 7, 3, "little"), bool(content[0] & 2), bool(content[0] & 16)
    if name == b"VP8 " and len(content) >= 10 and not content[0] & 1 and content[3:6] == b"\x9d\x01\x2a":
        width, height = number(content, 6, 2, "little") & 0x3FFF, number(content, 8, 2, "little") & 0x3FFF
        return (width, height, False, False) if width and height else None
    if name == b"VP8L" and len(content) >= 5 and content[0] == 0x2F:
        bits = number(content, 1, 4, "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, False, bool(bits >> 28 & 1)
    return None


class Bits:
    """Bits from the least significant on."""

    def __init__(self, data: bytes):
        self.all, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        value = self.all & ((1 << n) - 1)
        self.all >>= n
        self.left -= n
        return value

    def choice(self, *ways: tuple[int, int]) -> int:
        """One of four (bits, offset), chosen by two bits."""
        bits, offset = ways[self.take(2)]
        return self.take(bits) + offset

    def named(self) -> int:
        return self.choice((0, 0), (0, 1), (4, 2), (6, 18))


def jxl_codestream(data: bytes) -> bytes:
    if data[:2] == b"\xff\x0a":
        return data
    boxes = list(iso_boxes_flat(data))
    whole = [data[at : at + n] for kind, at, n in boxes if kind == "jxlc"]
    return whole[0] if whole else b"".join(data[at + 4 : at + n] for kind, at, n in boxes if kind == "jxlp")


def jxl_side(bits: Bits, by_eight: int) -> int:
    return 8 * (bits.take(5) + 1) if by_eight else bits.choice((9, 1), (13, 1), (18, 1), (30, 1))


def jxl_sides(bits: Bits) -> tuple[int, int]:
    #: The ratios of width to height that a header names.
    ratios = ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))
    by_eight = bits.take(1)
    height = jxl_side(bits, by_eight)
    ratio = bits.take(3)
    return (height * ratios[ratio - 1][0] // ratios[ratio - 1][1] if ratio else jxl_side(bits, by_eight)), height


def jxl(data: bytes) -> Seen | None:
    """The size header and the image metadata up to the colour encoding; a gain map in a box counts as HDR."""
    stream = jxl_codestream(data)
    if stream[:2] != b"\xff\x0a":
        return None
    try:
        bits = Bits(stream[2:512])
        width, height = jxl_sides(bits)
        orientation, transfer = jxl_metadata(bits)
    except (EOFError, ValueError):
        return None
    gain = any(kind == "jhgm" and n for kind, _, n in iso_boxes_flat(data)) if data[:2] != b"\xff\x0a" else False
    return shown(width, height, orientation, transfer in HDR_TRANSFERS or gain)


def jxl_metadata(bits: Bits) -> tuple[int, int]:
    """Orientation, and the transfer characteristics (13 for sRGB; 2 where a gamma or a profile says more)."""
    if bits.take(1):
        return 1, 13
    orientation, animated = 1, False
    if bits.take(1):
        orientation = bits.take(3) + 1
        if bits.take(1):
            jxl_sides(bits)
        if bits.take(1):
            raise ValueError("a preview stands before the image")
        animated = bool(bits.take(1))
        if animated:
            bits.choice((0, 100), (0, 1000), (10, 1), (30, 1))
            bits.choice((0, 1), (0, 1001), (8, 1), (10, 1))
            bits.choice((0, 0), (3, 0), (16, 0), (32, 0))
            bits.take(1)
    if bits.take(1):  # floating point samples
        bits.choice((0, 32), (0, 16), (0, 24), (6, 1))
        bits.take(4)
    else:
        bits.choice((0, 8), (0, 10), (0, 12), (6, 1))
    bits.take(1)
    for _ in range(bits.choice((0, 0), (0, 1), (4, 2), (12, 1))):
        if not bits.take(1):
            raise ValueError("a channel of its own kind")
    bits.take(1)  # whether the image is stored in the format's own colours
    if bits.take(1):
        return orientation, 13
    if bits.take(1):
        return orientation, 2
    space = bits.named()
    if space != 2:  # the format's own space has no white point
        if bits.named() == 2:
            for _ in range(2):
                bits.choice((19, 0), (19, 524288), (20, 1048576), (21, 2097152))
        if space != 1 and bits.named() == 2:
            for _ in range(6):
                bits.choice((19, 0), (19, 524288), (20, 1048576), (21, 2097152))
    if bits.take(1):
        return orientation, 2
    return orientation, bits.named()


#: Header sizes and compressions of bitmap files.
CORE, SHORTEST_OS2, INFO, V2, V3, OS2 = 12, 16, 40, 52, 56, 64
RGB, RLE8, RLE4, FIELDS, ALPHA_FIELDS = 0, 1, 2, 3, 6
MOST_SIDE, MOST_RLE_PIXELS = 1 << 20, 1 << 28
STANDARD_MASKS = (0x00FF0000, 0x0000FF00, 0x000000FF)


@dataclass
class Bitmap:
    width: int
    height: int
    bottom_up: bool
    depth: int
    layout: str
    palette: int
    pixels_at: int
    masks: tuple[int, int, int, int]


def bitmap(data: bytes, header: int = 14, pixels_at: int | None = None) -> Bitmap | None:
    """A bitmap's header, its palette's length, where its pixels are, and its layout; null if it is none that is read."""
    pixels_at = number(data, 10, 4, "little") if pixels_at is None else pixels_at
    size = number(data, header, 4, "little")
    if size < CORE or size > len(data) - header:
        return None
    if size == CORE:
        width, height, depth, compression, used = number(data, header + 4, 2, "little"), number(data, header + 6, 2, "little"), number(data, header + 10, 2, "little"), RGB, 0
    elif size >= SHORTEST_OS2:
        width, height = struct.unpack_from("<ii", data, header + 4)
        depth = number(data, header + 14, 2, "little")
        compression = number(data, header + 16, 4, "little") if size >= 20 else RGB
        used = number(data, header + 32, 4, "little") if size >= 36 else 0
    else:
        return None
    # OS/2 numbers other schemes where Windows has bit fields
    if (size == OS2 or size < INFO) and compression >= FIELDS:
        return None
    if not 0 < width <= MOST_SIDE or not 0 < abs(height) <= MOST_SIDE:
        return None
    palette_at, masks = header + size, (0, 0, 0, 0)
    if compression in (FIELDS, ALPHA_FIELDS):
        start, count = (header + 40, 4 if size >= V3 else 3) if size >= V2 else (palette_at, 4 if compression == ALPHA_FIELDS else 3)
        masks = (*(number(data, start + 4 * k, 4, "little") for k in range(count)), *[0] * (4 - count))
        palette_at += 0 if size >= V2 else 4 * count
    layout = bitmap_layout(compression, depth, masks)
    if layout is None or (layout.startswith("rle") and (height < 0 or width * height > MOST_RLE_PIXELS)):
        return None
    if compression == RGB and depth == 16:
        masks = (0x7C00, 0x03E0, 0x001F, 0)
    elif compression == RGB and depth == 32:
        masks = (*STANDARD_MASKS, 0xFF000000)
    colours = 0
    if layout in ("indexed", "rle8", "rle4"):
        entry, most = 3 if size == CORE else 4, 1 << depth
        end = min(pixels_at, len(data)) if pixels_at > palette_at else len(data)
        colours = min(used if 0 < used < most else most, max(0, end - palette_at) // entry)
        palette_at += colours * entry
    pixels_at = pixels_at if 0 < pixels_at < len(data) else palette_at
    return Bitmap(width, abs(height), height > 0, depth, layout, colours, pixels_at, masks) if pixels_at < len(data) else None


def bitmap_layout(compression: int, depth: int, masks: tuple[int, ...]) -> str | None:
    if compression in (RLE8, RLE4):
        return {(RLE8, 8): "rle8", (RLE4, 4): "rle4"}.get((compression, depth))
    if compression in (FIELDS, ALPHA_FIELDS):
        plain = masks[:3] == STANDARD_MASKS and masks[3] in (0, 0xFF000000)
        return {16: "masked16", 32: "bgra" if plain else "masked32"}.get(depth)
    return {1: "indexed", 2: "indexed", 4: "indexed", 8: "indexed", 16: "masked16", 24: "bgr", 32: "bgra"}.get(depth) if compression == RGB else None


def bmp(data: bytes) -> Seen | None:
    found = bitmap(data)
    return Seen(found.width, found.height) if found else None


PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Beginnings of JPEG 2000 and, by tag, the side of an icon and what holds its mask.
JPEG_2000 = (b"\0\0\0\x0cjP  \r\n\x87\n", b"\xff\x4f\xff\x51")
ICON_TYPES = {
    "icp4": (16, ""), "icp5": (32, ""), "icp6": (64, ""), "ic07": (128, ""), "ic08": (256, ""), "ic09": (512, ""), "ic10": (1024, ""), "ic11": (32, ""),
    "ic12": (64, ""), "ic13": (256, ""), "ic14": (512, ""), "is32": (16, "s8mk"), "il32": (32, "l8mk"), "ih32": (48, "h8mk"), "it32": (128, "t8mk"),
}


@dataclass
class Icon:
    width: int
    height: int
    payload: str
    at: int
    length: int
    mask_at: int = 0
    mask_length: int = 0


def icon_score(width: int, height: int, preference: int) -> int:
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        return -1
    return width * height * 64 + min(max(preference, 0), 63)


def png_sides(part: bytes) -> tuple[int, int] | None:
    return struct.unpack_from(">ii", part, 16) if part[:8] == PNG_MAGIC and len(part) >= 24 else None


def largest_ico(data: bytes) -> Icon | None:
    if len(data) < 6 or data[:4] != b"\0\0\1\0":
        return None
    best, out = -1, None
    for k in range(min(number(data, 4, 2, "little"), (len(data) - 6) // 16)):
        size, offset = struct.unpack_from("<II", data, 6 + 16 * k + 8)
        if not size or offset > len(data) or size > len(data) - offset:
            continue
        part = data[offset : offset + size]
        sides, depth = png_sides(part), 32
        payload = "png" if sides else "dib"
        if sides is None:
            if number(part, 0, 4, "little") < INFO or len(part) < 16:
                continue
            width, height = struct.unpack_from("<ii", part, 4)
            # the height counts the mask below the pixels; halves are cut towards zero
            sides, depth = (width, int(height / 2)), number(part, 14, 2, "little")
        if icon_score(*sides, depth) > best:
            best, out = icon_score(*sides, depth), Icon(*sides, payload, offset, size)
    return out


def largest_icns(data: bytes) -> Icon | None:
    if data[:4] != b"icns":
        return None
    chunks, at, end = [], 8, min(number(data, 4, 4), len(data))
    while at + 8 <= end and 8 <= number(data, at + 4, 4) <= end - at:
        chunks.append((data[at : at + 4].decode("latin-1"), at + 8, number(data, at + 4, 4) - 8))
        at += number(data, at + 4, 4)
    best, out, masked = -1, None, ""
    for tag, at, size in chunks:
        if tag not in ICON_TYPES:
            continue
        side, mask = ICON_TYPES[tag]
        part = data[at : at + size]
        if mask:
            skip = min(4, size) if tag == "it32" else 0  # the largest packed kind has four zeros before its planes
            found, preference = Icon(side, side, "packed", at + skip, size - skip), 1
        elif sides := png_sides(part):
            found, preference = Icon(*sides, "png", at, size), 3
        elif part.startswith(JPEG_2000):
            found, preference = Icon(side, side, "jpeg2000", at, size), 2
        else:
            continue
        if icon_score(found.width, found.height, preference) > best:
            best, out, masked = icon_score(found.width, found.height, preference), found, mask
    for tag, at, size in chunks:
        if out and masked and tag == masked:  # the last one counts
            out.mask_at, out.mask_length = at, size
    return out


def icon(data: bytes) -> Seen | None:
    found = largest_icns(data) if data[:4] == b"icns" else largest_ico(data)
    return Seen(found.width, found.height) if found else None


@dataclass
class HeifColour:
    transfer: str
    gain_map: bool


def heif_colour(data: bytes) -> HeifColour:
    """The transfer of the primary item's colour property, and whether the file has a gain map."""
    boxes = lambda part: [(kind, part[at : at + n]) for kind, at, n in iso_boxes_flat(part)]
    first = lambda some, name: next((body for kind, body in some if kind == name), b"")
    meta = first(boxes(data), "meta")
    if len(meta) < 4:
        return HeifColour("srgb", False)
    inside = boxes(meta[4:])
    properties = boxes(first(inside, "iprp"))
    held = boxes(first(properties, "ipco"))
    items = first(inside, "iinf")
    entries = boxes(items[4 + (2 if items[:1] == b"\0" else 4) :]) if items else []
    # the type stands behind an identifier (of 16 bits in version 2) and a protection index
    mapped = any(kind == "infe" and body[:1] >= b"\2" and body[4 + (2 if body[0] == 2 else 4) + 2 :][:4] == b"tmap" for kind, body in entries)
    apple = any(kind == "auxC" and body[4:].split(b"\0")[0] == APPLE_GAIN_MAP for kind, body in held)
    pitm = first(inside, "pitm")
    primary = number(pitm, 4, 4) if pitm[:1] > b"\0" else number(pitm, 4, 2)
    transfer = "srgb"
    for kind, body in properties:
        for index in associated(body, primary) if kind == "ipma" else ():
            name, said = held[index - 1] if 0 < index <= len(held) else ("", b"")
            if name == "colr" and said[:4] == b"nclx":
                transfer = HDR_TRANSFERS.get(number(said, 6, 2), "linear" if number(said, 6, 2) == 8 else "srgb")
    return HeifColour(transfer, mapped or apple)


def associated(ipma: bytes, item: int) -> Iterator[int]:
    """Numbers, from 1, of the properties of an item."""
    if len(ipma) < 8:
        return
    id_size, index_size, at = 4 if ipma[0] else 2, 2 if ipma[3] & 1 else 1, 8
    for _ in range(number(ipma, 4, 4)):
        if at >= len(ipma):
            return
        found, at = number(ipma, at, id_size), at + id_size
        count, at = number(ipma, at, 1), at + 1
        for _ in range(count):
            if at >= len(ipma):
                return
            if found == item:
                yield number(ipma, at, index_size) & (0x7FFF if index_size == 2 else 0x7F)
            at += index_size


def heif(data: bytes) -> Seen | None:
    """The sides of the largest image property; a turn or a mirror is left to a decoder."""
    found = heif_colour(data)
    sides = [struct.unpack_from(">II", data, at + 4) for kind, at, n in iso_boxes_deep(data) if kind == "ispe" and n >= 12]
    best = max(sides, key=lambda s: s[0] * s[1], default=None)
    return Seen(best[0], best[1], 1, found.gain_map or found.transfer in ("pq", "hlg")) if best else None


def iso_boxes_deep(data: bytes) -> Iterator[tuple[str, int, int]]:
    from .headers import iso_boxes

    return iso_boxes(data)


def mpf_images(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the images behind the first one, by the multi-picture index."""
    out = []
    for marker, at, size in jpeg_segments(data):
        if marker != "E2" or data[at : at + 4] != MPF_HEAD:
            continue
        origin, tiff = at + 4, data[at + 4 : at + size]
        order = "little" if tiff[:2] == b"II" else "big"
        first = number(tiff, 4, 4, order)
        for k in range(number(tiff, first, 2, order)):
            entry = first + 2 + 12 * k
            if number(tiff, entry, 2, order) != 0xB002:
                continue
            table, said = number(tiff, entry + 8, 4, order), number(tiff, entry + 4, 4, order) // 16
            # the first entry is the image itself; no more are read than fit
            for i in range(1, min(said, max(0, len(tiff) - table) // 16)):
                length, offset = number(tiff, table + 16 * i + 4, 4, order), number(tiff, table + 16 * i + 8, 4, order)
                if offset and origin + offset < len(data) and length <= len(data) - origin - offset:
                    out.append((origin + offset, length))
            break
    return out


@dataclass
class GainMap:
    """Logarithms, gammas and offsets of the three channels, and the headrooms at which the map is off and full."""

    channels: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    gamma: tuple[float, float, float]
    base_offset: tuple[float, float, float]
    other_offset: tuple[float, float, float]
    base_headroom: float
    other_headroom: float
    base_colours: bool = False


def gain_map_iso(data: bytes) -> GainMap | None:
    """The binary form: fractions of 32-bit numbers; a byte of zero may stand before it."""
    for start in (0, 1) if data[:1] == b"\0" else (0,):
        if start + 5 > len(data) or number(data, start, 2):
            continue
        flags = data[start + 4]
        count = 3 if flags & 0x80 else 1
        if len(data) != start + 21 + 40 * count:
            continue
        numbers = struct.unpack_from(f">{4 + 10 * count}I", data, start + 5)
        pairs = list(zip(numbers[::2], numbers[1::2], strict=True))
        if any(bottom == 0 for _, bottom in pairs):
            continue
        plain = [top / bottom for top, bottom in pairs]
        signed = [(top - (1 << 32) * (top >> 31)) / bottom for top, bottom in pairs]
        spread = lambda some, k: tuple(some[2 + 5 * min(c, count - 1) + k] for c in range(3))
        found = GainMap(count, spread(signed, 0), spread(signed, 1), spread(plain, 2), spread(signed, 3), spread(signed, 4), plain[0], plain[1], bool(flags & 0x40))
        if min(found.gamma) > 0:
            return found
    return None


def xmp_value(xmp: str, name: str) -> str:
    """A property of the gain-map namespace, as attribute or element; empty if it is absent."""
    import re

    for m in re.finditer(rf"(<?)hdrgm:{name}(?:=(['\"])|(>))", xmp):
        if m[2]:
            end = xmp.find(m[2], m.end())
        else:
            end = xmp.find(f"</hdrgm:{name}", m.end()) if m[1] else -1
        if end >= 0:
            return xmp[m.end() : end]
    return ""


def leading_number(text: str) -> float | None:
    import re

    m = re.match(r"[ \n\t+]*(-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text)
    return float(m[1]) if m else None


def gain_map_xmp(xmp: str) -> GainMap | None:
    if not xmp_value(xmp, "Version") or xmp_value(xmp, "BaseRenditionIsHDR") == "True":
        return None
    count = 1

    def three(name: str, default: float | None) -> tuple[float, float, float] | None:
        nonlocal count
        text = xmp_value(xmp, name)
        if not text:
            return None if default is None else (default,) * 3
        items = [leading_number(part) for part in text.split("<rdf:li>")[1:]]
        some = [v for v in items if v is not None] or [v for v in (leading_number(text),) if v is not None]
        if len(some) not in (1, 3):
            return None
        count = max(count, len(some))
        return tuple(some * (3 // len(some)))

    def one(name: str, default: float | None) -> float | None:
        text = xmp_value(xmp, name)
        return leading_number(text) if text else default

    #: What a property is where it isn't said; the most and the full headroom must be.
    parts = [three("GainMapMin", 0.0), three("GainMapMax", None), three("Gamma", 1.0), three("OffsetSDR", 1 / 64), three("OffsetHDR", 1 / 64)]
    ends = [one("HDRCapacityMin", 0.0), one("HDRCapacityMax", None)]
    if any(p is None for p in (*parts, *ends)) or min(parts[2]) <= 0:
        return None
    return GainMap(count, *parts, *ends)


def jpeg_gain_map(data: bytes) -> tuple[int, int, GainMap] | None:
    """(offset, length, metadata) of the first further image that says it is a gain map; the binary form goes first."""
    for offset, length in mpf_images(data):
        image = data[offset : offset + length]
        parts = [(marker, image[at : at + n]) for marker, at, n in jpeg_segments(image)]
        binary = (gain_map_iso(body[len(ISO_HEAD) :]) for marker, body in parts if marker == "E2" and body.startswith(ISO_HEAD))
        text = (gain_map_xmp(body[len(XMP_HEAD) :].decode("utf-8", "replace")) for marker, body in parts if marker == "E1" and body.startswith(XMP_HEAD))
        found = next((m for some in (binary, text) for m in some if m), None)
        if found:
            return offset, length, found
    return None


def jxl_gain_map(box: bytes) -> tuple[int, int, GainMap] | None:
    """(offset, length, metadata) in a jhgm box: version, metadata, colour encoding, profile, image."""
    size = number(box, 1, 2)
    at = 3 + size
    found = gain_map_iso(box[3:at]) if len(box) >= 3 and at < len(box) else None
    if found is None:
        return None
    encoding = box[at]
    srgb = encoding > 0 and at + 1 < len(box) and bool(box[at + 1] & 1)
    at += 1 + encoding
    if at + 4 > len(box):
        return None
    profile, at = number(box, at, 4), at + 4
    if profile > len(box) - at or not (found.base_colours or srgb) or at + profile == len(box):
        return None
    return at + profile, len(box) - at - profile, found


@dataclass
class RestartIndex:
    """Where each step of rows starts in a JPEG with restart markers, and where its data ends."""

    width: int
    height: int
    step_rows: int
    margin: int
    starts: list[int]
    end: int


MOST_STEP = 1024


def restart_layout(data: bytes) -> tuple[int, int, int, int, int, int, int, int] | None:
    """width, height, rows a step, margin in steps, intervals a step, intervals, steps, offset of the scan."""
    if data[:2] != b"\xff\xd8":
        return None
    at, interval, frame = 2, 0, None
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        size = number(data, at + 2, 2)
        if at + 4 > len(data) or data[at] != 0xFF or size < 2 or at + 2 + size > len(data):
            return None
        marker, body = data[at + 1], data[at + 4 : at + 2 + size]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC0, 0xC1, 0xC4, 0xC8):
            return None  # progressive, lossless, arithmetic
        if marker in (0xC0, 0xC1):
            frame = body
            if len(body) < 6 or body[0] != 8 or body[5] not in (1, 3) or len(body) < 6 + 3 * body[5]:
                return None
        if marker == 0xDD and len(body) >= 2:
            interval = number(body, 0, 2)
        at += 2 + size
        if marker == 0xDA:
            if frame is None or not body or body[0] != frame[5]:
                return None
            break
    height, width, parts = number(frame, 1, 2), number(frame, 3, 2), frame[5]
    factors = [frame[7 + 3 * k] for k in range(parts)]
    wide, tall = (1, 1) if parts == 1 else (max(f >> 4 for f in factors), max(f & 15 for f in factors))
    if not width or not height or not interval or not wide or not tall:
        return None
    per_row, rows = -(-width // (8 * wide)), -(-height // (8 * tall))
    step = interval // math.gcd(interval, per_row)
    margin = int(parts == 3 and any(f & 15 < tall for f in factors))
    if step * 8 * tall > MOST_STEP:
        return None
    return width, height, step * 8 * tall, margin, step * per_row // interval, -(-per_row * rows // interval), -(-rows // step), at


def restart_index(data: bytes) -> RestartIndex | None:
    """By a walk over the scan's markers; anything but restarts and the end of the image gives no index."""
    found = restart_layout(data)
    if found is None:
        return None
    width, height, rows, margin, per_step, intervals, steps, scan = found
    starts, restarts, at = [scan], 0, data.find(b"\xff", scan)
    while 0 <= at < len(data) - 1 and data[at + 1] != 0xD9:
        code = data[at + 1]
        if 0xD0 <= code <= 0xD7:
            restarts += 1
            if restarts % per_step == 0:
                starts.append(at + 2)
        elif code not in (0x00, 0xFF):
            return None
        at = data.find(b"\xff", at + (1 if code == 0xFF else 2))
    if not 0 <= at < len(data) - 1 or restarts + 1 != intervals or len(starts) != steps:
        return None
    return RestartIndex(width, height, rows, margin, starts, at)


def adopt_starts(data: bytes, starts: list[int]) -> RestartIndex | None:
    """An index from starts that were kept: ordered, a marker apart, within the file; only the last step is looked through."""
    found = restart_layout(data)
    if found is None or len(starts) != found[6] or starts[0] != found[7]:
        return None
    if any(b < a + 2 or b >= len(data) for a, b in zip(starts, starts[1:], strict=False)):
        return None
    end = data.find(b"\xff\xd9", starts[-1])
    return RestartIndex(*found[:4], list(starts), end) if end >= 0 else None


PROBES: dict[str, Callable[[bytes], Seen | None]] = {"Jpeg": jpeg, "Png": png, "WebP": webp, "Jxl": jxl, "Bmp": bmp, "Ico": icon, "Icns": icon, "Heif": heif}


def by_file(files: DataFrame, schema: str, read: Callable[[bytes, dict], Iterator[tuple]], columns: tuple[str, ...] = ("id", "content")) -> DataFrame:
    """files: id, content and others of ``columns``; ``read`` gives the rows of a file, behind its id."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(r["id"], *found) for r in rows.to_dict("records") for found in read(bytes(r["content"] or b""), r)]
            yield pd.DataFrame(out, columns=["id", *names])

    return files.select(*columns).mapInPandas(run, f"id bigint, {schema}")


def probe(files: DataFrame) -> DataFrame:
    """files: id, kind, content.  id, width, height (as shown), orientation, hdr, of files whose header could be read."""

    def read(data: bytes, row: dict) -> Iterator[tuple]:
        found = PROBES[row["kind"]](data) if row["kind"] in PROBES else None
        if found:
            yield astuple(found)

    return by_file(files, "width int, height int, orientation int, hdr boolean", read, ("id", "kind", "content"))


def bitmaps(files: DataFrame) -> DataFrame:
    """The header fields of bitmap files that can be read."""

    def read(data: bytes, _: dict) -> Iterator[tuple]:
        if data[:2] == b"BM" and (b := bitmap(data)):
            yield b.width, b.height, b.bottom_up, b.depth, b.layout, b.palette, b.pixels_at, *b.masks

    return by_file(files, "width int, height int, bottom_up boolean, depth int, layout string, palette int, pixels_at bigint, red bigint, green bigint, blue bigint, alpha bigint", read)


def largest_icons(files: DataFrame) -> DataFrame:
    """The largest entry of icon files of either kind, with its mask."""

    def read(data: bytes, _: dict) -> Iterator[tuple]:
        if i := (largest_icns(data) if data[:4] == b"icns" else largest_ico(data)):
            yield astuple(i)

    return by_file(files, "width int, height int, payload string, at bigint, length bigint, mask_at bigint, mask_length bigint", read)


_GAIN = "at bigint, length bigint, channels int, low double, high double, gamma double, base_offset double, other_offset double, base_headroom double, other_headroom double, base_colours boolean"


def gain_maps(files: DataFrame) -> DataFrame:
    """Of JPEG and JPEG XL files with a gain map: where it is, and its metadata (of the first channel)."""

    def read(data: bytes, _: dict) -> Iterator[tuple]:
        found, shift = (jpeg_gain_map(data), 0) if data[:2] == b"\xff\xd8" else (None, 0)
        if data[:2] != b"\xff\xd8":
            found, shift = next(((g, at) for kind, at, n in iso_boxes_flat(data) if kind == "jhgm" and (g := jxl_gain_map(data[at : at + n]))), (None, 0))
        if found:
            at, length, m = found
            yield at + shift, length, m.channels, m.low[0], m.high[0], m.gamma[0], m.base_offset[0], m.other_offset[0], m.base_headroom, m.other_headroom, m.base_colours

    return by_file(files, _GAIN, read)


def further_images(files: DataFrame) -> DataFrame:
    """id, seq, at, length of the images behind the first one of a JPEG."""
    return by_file(files, "seq int, at bigint, length bigint", lambda data, _: ((k, *x) for k, x in enumerate(mpf_images(data))))


def heif_colours(files: DataFrame) -> DataFrame:
    return by_file(files, "transfer string, gain_map boolean", lambda data, _: iter([astuple(heif_colour(data))]))


def restart_steps(files: DataFrame, kept: bool = False) -> DataFrame:
    """id, step, at, ends: where each step of rows of a JPEG begins and ends.  With ``kept``, files have their ``starts``."""

    def read(data: bytes, row: dict) -> Iterator[tuple]:
        found = adopt_starts(data, [int(x) for x in row["starts"]]) if kept else restart_index(data)
        if found:
            # a step ends before the marker that the next one starts behind
            ends = [*(s - 2 for s in found.starts[1:]), found.end]
            yield from ((k, a, b, found.step_rows, found.margin) for k, (a, b) in enumerate(zip(found.starts, ends, strict=True)))

    return by_file(files, "step int, at bigint, ends bigint, step_rows int, margin int", read, ("id", "content", *(("starts",) if kept else ())))
