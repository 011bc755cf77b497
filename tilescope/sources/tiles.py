"""Pyramids as tables: written level by level, read back by level and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import raster as R


def write_pyramid(px: DataFrame, path: str, levels: int, tile: int = 1024) -> None:
    """Pixels of each level under ``level=k``, by tile.

    A level is made from the one just written and read again, so lineage does not grow
    and no level is computed twice.  Spark's commit protocol writes aside and renames.
    """
    spark = px.sparkSession
    level, size = px, R.dims(px)
    for k in range(levels):
        if k:
            level, size = R.halve(level, size), R.half_size(size)
        keyed = level.select("image", "x", "y", *R.RGBA).withColumn("column", F.expr(f"int(x div {tile})")).withColumn("row", F.expr(f"int(y div {tile})"))
        keyed.repartitionByRange("image", "row", "column").sortWithinPartitions("image", "row", "column").write.mode("overwrite").parquet(f"{path}/level={k}")
        level = spark.read.parquet(f"{path}/level={k}")


def read_tiles(spark: SparkSession, path: str, level: int, column: tuple[int, int], row: tuple[int, int]) -> DataFrame:
    """Pixels of a range of tiles: the level prunes folders, literal ranges prune row groups."""
    return spark.read.parquet(path).where(f"level = {level} and column between {column[0]} and {column[1]} and row between {row[0]} and {row[1]}")


def tile_index(tiles: DataFrame) -> DataFrame:
    """Adds ``offset``: bytes of the tiles before, in writing order within an image."""
    order = Window.partitionBy("image").orderBy("level", "row", "column").rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("offset", F.coalesce(F.sum("bytes").over(order), F.lit(0)))


def sound(headers: DataFrame, version: int = 6, tile: int = 1024) -> DataFrame:
    """Headers of tile files that can be used: version, tile side, channels and table within the file."""
    return headers.where(F.expr(f"version = {version} and tile = {tile} and channels in (3, 4) and levels > 0 and table_at + levels * 16 <= size"))
