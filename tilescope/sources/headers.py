"""Sequential walks over the bytes of files, as Python table functions over Arrow batches.

Where a walk's next step depends on the one before (marker segments, chunks, run
lengths) no expression can say it; each file is a row of its own, so files spread
over tasks and nothing is gathered.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def exif_orientation(data: bytes) -> int:
    """Tag 0x0112 of the first directory; anything out of range is 1."""
    if data[:4] == b"Exif" and len(data) >= 6:
        data = data[6:]
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return 1
    at = struct.unpack_from(order + "I", data, 4)[0]
    if at + 2 > len(data):
        return 1
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        if struct.unpack_from(order + "H", data, entry)[0] == 0x0112:
            value = struct.unpack_from(order + "H", data, entry + 8)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def jpeg_segments(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(marker, offset of its content, length) of the segments before the scan that fit; fill bytes are passed."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        if data[at + 1] == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        if length < 2 or at + 2 + length > len(data):
            return
        yield f"{data[at + 1]:02X}", at + 4, length - 2
        at += 2 + length


def png_chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    at = 8
    while at + 12 <= len(data):
        length = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8].decode("latin-1"), at + 8, length
        at += 12 + length


def riff_chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    at = 12
    while at + 8 <= len(data):
        length = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4].decode("latin-1"), at + 8, length
        at += 8 + length + (length & 1)


def icns_chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    at = 8
    while at + 8 <= len(data):
        length = struct.unpack_from(">I", data, at + 4)[0]
        if length < 8:
            return
        yield data[at : at + 4].decode("latin-1"), at + 8, length - 8
        at += length


def ico_entries(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(WxHxbits, offset, length) of a directory's entries; a side of 0 is 256."""
    for k in range(struct.unpack_from("<H", data, 4)[0] if len(data) >= 6 else 0):
        at = 6 + 16 * k
        if at + 16 > len(data):
            return
        w, h, _, _, _, bits, length, offset = struct.unpack_from("<BBBBHHII", data, at)
        yield f"{w or 256}x{h or 256}x{bits}", offset, length


def iso_boxes_flat(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """Boxes one after the other, up to the first that does not fit: (kind, offset of its content, length)."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, size - head
        at += size


def iso_boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """The same, with what is in the containers of metadata behind each of them."""
    for kind, start, size in iso_boxes_flat(data, at, end):
        yield kind, start, size
        if kind in ("meta", "iprp", "ipco"):
            yield from iso_boxes(data, start + (4 if kind == "meta" else 0), start + size)


WALKS: dict[str, Callable[[bytes], Iterator[tuple[str, int, int]]]] = {
    "jpeg": jpeg_segments, "png": png_chunks, "riff": riff_chunks, "icns": icns_chunks, "ico": ico_entries, "iso": iso_boxes,
}


def walk(files: DataFrame, kind: str) -> DataFrame:
    """files: id, content.  id, seq, name, at, length of each part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, k, *p) for i, data in zip(rows["id"], rows["content"], strict=True) for k, p in enumerate(WALKS[kind](bytes(data or b"")))]
            yield pd.DataFrame(out, columns=["id", "seq", "name", "at", "length"])

    return files.select("id", "content").mapInPandas(run, "id bigint, seq int, name string, at bigint, length bigint")


def orientations(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "orientation": [exif_orientation(bytes(d or b"")) for d in rows["content"]]})

    return files.select("id", "content").mapInPandas(run, "id bigint, orientation int")


def unpack_runs(data: bytes) -> bytes:
    """Packed icon planes: a byte below 128 is followed by that many literals and one, else the next repeats byte - 125 times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (n - 125)
            at += 2
    return bytes(out)


def bmp_rle(data: bytes, width: int, height: int, nibbles: bool = False) -> bytes:
    """Run-length rows of a BMP as palette entries, bottom row first; what is skipped stays 0.  ``nibbles``: two pixels a byte."""
    out, x, y, at = bytearray(width * height), 0, 0, 0

    def put(values: bytes) -> None:
        nonlocal x
        part = values[: max(0, width - x)]
        out[y * width + x : y * width + x + len(part)] = part
        x += len(part)

    halves = lambda some: bytes(v for b in some for v in (b >> 4, b & 15))
    while at + 1 < len(data) and y < height:
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            put((halves([v]) * 128)[:n] if nibbles else bytes([v]) * n)
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            if at + 2 > len(data):
                break
            x, y, at = min(x + data[at], width), y + data[at + 1], at + 2
        else:
            size = (v + 1) // 2 if nibbles else v
            if at + size > len(data):
                break
            put(halves(data[at : at + size])[:v] if nibbles else data[at : at + size])
            at += size + size % 2
    return bytes(out)


def unfilter_png(rows: bytes, stride: int, step: int) -> bytes:
    """Undo the filters None, Sub, Up, Average and Paeth of PNG rows, each led by its filter's number."""
    out, above = bytearray(), bytes(stride)
    for at in range(0, len(rows) - stride, stride + 1):
        kind, line = rows[at], bytearray(rows[at + 1 : at + 1 + stride])
        for k in range(stride):
            a = line[k - step] if k >= step else 0
            b, c = above[k], above[k - step] if k >= step else 0
            if kind == 1:
                add = a
            elif kind == 2:
                add = b
            elif kind == 3:
                add = (a + b) // 2
            elif kind == 4:
                p = a + b - c
                pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                add = a if pa <= pb and pa <= pc else b if pb <= pc else c
            else:
                add = 0
            line[k] = (line[k] + add) & 255
        out += line
        above = bytes(line)
    return bytes(out)


def map_bytes(files: DataFrame, change: Callable[[bytes], bytes], column: str = "content") -> DataFrame:
    """files with their bytes changed, file by file."""
    names = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(**{column: [change(bytes(d)) if d is not None else None for d in rows[column]]})[names]

    return files.mapInPandas(run, files.schema)
