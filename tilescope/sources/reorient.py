"""Saving an orientation into the bytes of JPEG, PNG, WebP and TIFF files.

A file's change is a list of splices (at, length, bytes): what is there is replaced.
They are planned by the file's kind, and applied to its bytes in one pass.  Where an
orientation that was added is taken back to 1, so is the block that was added with it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .headers import jpeg_segments
from .probes import webp_size

Splice = tuple[int, int, bytes]
EXIF = b"Exif\0\0"
ORIENTATION, SHORT = 0x0112, 3


class Refused(ValueError):
    """Why a file can't take an orientation."""


def spliced(data: bytes, splices: list[Splice]) -> bytes:
    out, at = [], 0
    for start, length, put in splices:
        out += [data[at:start], put]
        at = start + length
    return b"".join([*out, data[at:]])


def minimal(orientation: int) -> bytes:
    """The smallest block that says an orientation."""
    return b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, ORIENTATION, SHORT, 1, orientation, 0, 0)


def directory_splices(block: bytes, orientation: int, why: str) -> list[Splice]:
    """How the first directory of a TIFF block comes to say ``orientation``."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        raise Refused(why)
    magic, first = struct.unpack_from(f"{order}HI", block, 2)
    if magic != 42 or first < 8 or first + 2 > len(block):
        raise Refused(why)
    count = struct.unpack_from(f"{order}H", block, first)[0]
    end = first + 2 + 12 * count + 4
    if end > len(block):
        raise Refused(why)
    entries = [block[first + 2 + 12 * k : first + 14 + 12 * k] for k in range(count)]
    after = block[end - 4 : end]
    tags = [struct.unpack_from(f"{order}H", e)[0] for e in entries]
    pointer = lambda at: (4, 4, struct.pack(f"{order}I", at))
    written = lambda some: struct.pack(f"{order}H", len(some)) + b"".join(some) + after
    if ORIENTATION not in tags:
        if orientation == 1:
            return []
        # entries stand in the order of their tags; a copy of the directory goes behind everything
        at = next((k for k, t in enumerate(tags) if t >= ORIENTATION), count)
        added = struct.pack(f"{order}HHIHH", ORIENTATION, SHORT, 1, orientation, 0)
        return [pointer(len(block)), (len(block), 0, written([*entries[:at], added, *entries[at:]]))]
    at = max(k for k, t in enumerate(tags) if t == ORIENTATION)
    kind, n, value = struct.unpack_from(f"{order}HIH", entries[at], 2)
    if kind != SHORT or n != 1:
        raise Refused(why)
    if orientation == 1 and end == len(block):
        # a directory at the very end may be such a copy: the one it was made from is still there
        original = block.find(written([*entries[:at], *entries[at + 1 :]]), 8, first)
        if original >= 0:
            return [pointer(original), (first, len(block) - first, b"")]
    return [] if value == orientation else [(first + 2 + 12 * at + 8, 2, struct.pack(f"{order}H", orientation))]


def edited(block: bytes, orientation: int, why: str) -> tuple[bytes, bool]:
    """The block with the orientation, and whether it now says nothing more than that there is none."""
    out = spliced(block, directory_splices(block, orientation, why))
    return out, orientation == 1 and out == minimal(1)


def replaced(at: int, length: int, block: bytes, orientation: int, why: str, frame: Callable[[bytes], bytes]) -> list[Splice]:
    """An existing block of a file, framed anew, or taken out; it has ``length`` bytes with its frame."""
    new, gone = edited(block, orientation, why)
    return [(at, length, b"")] if gone else [(at, length, frame(new))] if new != block else []


def jpeg_segment(block: bytes) -> bytes:
    if len(block) + 8 > 0xFFFF:
        raise Refused("Exif too large for its segment")
    return b"\xff\xe1" + struct.pack(">H", len(block) + 8) + EXIF + block


def jpeg_splices(data: bytes, orientation: int) -> list[Splice]:
    # a new segment goes behind the leading APP0
    insert, leading, at, exif = 2, True, 2, None
    for marker, start, length in jpeg_segments(data):
        if marker == "D9":
            break
        leading = leading and marker == "E0"
        at = start + length
        insert = at if leading else insert
        if marker == "E1" and exif is None and data[start : start + 6] == EXIF:
            exif = (start, length)
    while data[at : at + 2] == b"\xff\xff":
        at += 1
    if at + 4 <= len(data) and data[at : at + 2] not in (b"\xff\xda", b"\xff\xd9"):
        raise Refused("malformed JPEG")
    if exif:
        start, length = exif
        return replaced(start - 4, length + 4, data[start + 6 : start + length], orientation, "unreadable Exif", jpeg_segment)
    return [(insert, 0, jpeg_segment(minimal(orientation)))] if orientation != 1 else []


def png_chunk(block: bytes) -> bytes:
    return struct.pack(">I", len(block)) + b"eXIf" + block + struct.pack(">I", zlib.crc32(b"eXIf" + block))


def png_splices(data: bytes, orientation: int) -> list[Splice]:
    at, behind = 8, 0
    while at + 12 <= len(data):
        length, kind = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8]
        if at + 12 + length > len(data) or (at == 8 and kind != b"IHDR"):
            break
        behind = behind or at + 12 + length
        if kind == b"eXIf":
            return replaced(at, 12 + length, data[at + 8 : at + 8 + length], orientation, "unreadable eXIf", png_chunk)
        if kind == b"IEND":
            break
        at += 12 + length
    if not behind:
        raise Refused("malformed PNG")
    return [(behind, 0, png_chunk(minimal(orientation)))] if orientation != 1 else []


FLAGS_AT, HAS_EXIF, HAS_ALPHA = 20, 8, 16


def riff_chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def extended_header(image: bytes) -> bytes:
    """What a lone image chunk gets before it, so that the file can have EXIF; nothing if it is no image."""
    size = webp_size(image)
    if size is None:
        return b""
    width, height, _, alpha = size
    flags = HAS_EXIF | (HAS_ALPHA if alpha else 0)
    return riff_chunk(b"VP8X", bytes([flags, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"))


def webp_splices(data: bytes, orientation: int) -> list[Splice]:
    parts, at = [], 12
    while at + 8 <= len(data):
        length = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + length > len(data):
            break
        parts.append((data[at : at + 4], at, length, 8 + length + (length & 1)))
        at += parts[-1][3]
    if not parts or at > len(data) or len(data) <= FLAGS_AT:
        raise Refused("malformed WebP")
    flag = lambda on: (FLAGS_AT, 1, bytes([data[FLAGS_AT] | HAS_EXIF if on else data[FLAGS_AT] & ~HAS_EXIF]))
    exif = next((p for p in parts if p[0] == b"EXIF"), None)
    if exif:
        _, start, length, total = exif
        body = data[start + 8 : start + 8 + length]
        prefix = EXIF if body.startswith(EXIF) else b""
        new, gone = edited(body[len(prefix) :], orientation, "unreadable EXIF")
        if gone and not prefix:
            header = data[12 : 12 + parts[0][3]]
            # the extended header goes too if it was made for this block alone
            alone = len(parts) == 3 and parts[2] == exif and header == extended_header(data[parts[1][1] : parts[1][1] + parts[1][3]])
            out = [(12, parts[0][3], b"") if alone else flag(False), (start, total, b"")]
        else:
            out = [(start, total, riff_chunk(b"EXIF", prefix + new))] if prefix + new != body else []
    elif orientation == 1:
        out = []
    else:
        block = riff_chunk(b"EXIF", minimal(orientation))
        if parts[0][0] == b"VP8X":
            before = next((p[1] for p in parts if p[0] == b"XMP "), len(data))
            out = [flag(True), (before, 0, block)]
        elif header := extended_header(data[12:]):
            out = [(12, 0, header), (len(data), 0, block)]
        else:
            raise Refused("malformed WebP")
    if not out:
        return []
    size = len(data) + sum(len(put) - length for _, length, put in out)
    return [(4, 4, struct.pack("<I", size - 8)), *out]


def tiff_splices(data: bytes, orientation: int) -> list[Splice]:
    return directory_splices(data, orientation, "unsupported TIFF layout")


PLANS: dict[str, Callable[[bytes, int], list[Splice]]] = {"Jpeg": jpeg_splices, "Png": png_splices, "WebP": webp_splices, "Tiff": tiff_splices}


def reoriented(data: bytes, kind: str, orientation: int) -> tuple[bytes, bool]:
    """The file's bytes, and whether every splice is as long as what it replaces, so that the file can be written in place."""
    if kind not in PLANS:
        raise Refused("this format keeps no orientation")
    splices = PLANS[kind](data, orientation)
    return spliced(data, splices), all(length == len(put) for _, length, put in splices)


def save_orientation(files: DataFrame) -> DataFrame:
    """files: id, kind, content, orientation.  id, content (changed), in_place, error (why it is as it was, or null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                data = bytes(r["content"] or b"")
                try:
                    out.append((r["id"], *reoriented(data, r["kind"], int(r["orientation"])), None))
                except Refused as why:
                    out.append((r["id"], data, None, str(why)))
            yield pd.DataFrame(out, columns=["id", "content", "in_place", "error"])

    return files.select("id", "kind", "content", "orientation").mapInPandas(run, "id bigint, content binary, in_place boolean, error string")
