"""Tiles in blob form: a row for each tile with its pixels as bytes, changed with NumPy in Arrow batches.

The same semantics as the long form of ``raster`` and ``codec``, for volume: a row carries
thousands of pixels.  A tile whose bytes cannot be read is a transparent hole, not an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "image int, column int, row int, width int, height int, data binary"


def to_tiles(px: DataFrame, tile: int) -> DataFrame:
    """Long form to blobs: bytes are r, g, b, a, row by row.  A group is one tile, of bounded size."""
    keyed = px.select("image", F.expr(f"int(x div {tile})").alias("column"), F.expr(f"int(y div {tile})").alias("row"), F.struct("y", "x", "r", "g", "b", "a").alias("p"))
    grouped = keyed.groupBy("image", "column", "row").agg(F.sort_array(F.collect_list("p")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            widths, heights, data = [], [], []
            for cells in part.column("p"):
                s = cells.values
                x, y = s.field("x").to_numpy(), s.field("y").to_numpy()
                widths.append(int(x.max() - x.min() + 1))
                heights.append(int(y.max() - y.min() + 1))
                data.append(np.stack([s.field(c).to_numpy() for c in "rgba"], axis=1).astype(np.uint8).tobytes())
            keys = [part.column(k) for k in ("image", "column", "row")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(widths, pa.int32()), pa.array(heights, pa.int32()), pa.array(data, pa.binary())], names=["image", "column", "row", "width", "height", "data"])

    return grouped.mapInArrow(run, SCHEMA)


def to_pixels(tiles: DataFrame, tile: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for image, column, row, width, height, data in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4).astype(np.int32)
                y, x = np.mgrid[0:height, 0:width]
                columns = {"image": np.full(width * height, image), "x": x.ravel() + column * tile, "y": y.ravel() + row * tile} | {c: pixels[:, :, k].ravel() for k, c in enumerate("rgba")}
                yield pa.RecordBatch.from_pydict({k: pa.array(v.astype(np.int32)) for k, v in columns.items()})

    return tiles.mapInArrow(run, "image int, x int, y int, r int, g int, b int, a int")


def map_tiles(tiles: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``change`` gets and returns (height, width, 4) bytes; sides may change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for width, height, data in zip(*(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                ok = data is not None and len(data) == width * height * 4
                out.append(change(np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4) if ok else np.zeros((height, width, 4), dtype=np.uint8)))
            sides = [pa.array([o.shape[1 - k] for o in out], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(3)], *sides, pa.array([o.astype(np.uint8).tobytes() for o in out], pa.binary())], names=part.schema.names)

    return tiles.mapInArrow(run, SCHEMA)


def halve_array(a: np.ndarray) -> np.ndarray:
    """Mean of 2 x 2, halves up; an odd last row or column counts twice."""
    a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2), (0, 0)), mode="edge").astype(np.uint16)
    return ((a[0::2, 0::2] + a[0::2, 1::2] + a[1::2, 0::2] + a[1::2, 1::2] + 2) >> 2).astype(np.uint8)


def residuals(a: np.ndarray) -> np.ndarray:
    """Red and blue less green, then each row less the one above, modulo 256."""
    a = a.copy()
    a[:, :, 0] -= a[:, :, 1]
    a[:, :, 2] -= a[:, :, 1]
    out = a.copy()
    out[1:] -= a[:-1]
    return out


def restored(a: np.ndarray) -> np.ndarray:
    out = np.cumsum(a, axis=0, dtype=np.uint8)
    out[:, :, 0] += out[:, :, 1]
    out[:, :, 2] += out[:, :, 1]
    return out


def packed_sizes(tiles: DataFrame) -> DataFrame:
    """image, column, row, raw, planes: bytes of a tile, and of its deflated residual planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes = []
            for width, height, data in zip(*(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                planes = residuals(np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4)).transpose(2, 0, 1)
                sizes.append((len(data), len(zlib.compress(planes.tobytes(), 1))))
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(3)], *[pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1)]], names=["image", "column", "row", "raw", "planes"])

    return tiles.mapInArrow(run, "image int, column int, row int, raw bigint, planes bigint")
