"""Queries over the fixtures, by area, each with the SQL that says the same where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cache, catalog, codec, files, headers, lookups, raster, stateful, timeline, tone, viewing, views

Query = Callable[[SparkSession, str], DataFrame]
_AREAS = (raster, codec, views, catalog, timeline, cache, tone, headers, files, lookups, viewing, stateful)


def queries() -> dict[str, Query]:
    return {name: q for area in _AREAS for name, (q, _) in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, (_, sql) in area.QUERIES.items() if sql}
