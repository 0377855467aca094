"""All queries of the library, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.queries import alignment, geostatistics, statistics, terrain, volume

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (terrain, statistics, alignment, volume, geostatistics)


def queries() -> dict[str, Query]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.SQL.items()}
