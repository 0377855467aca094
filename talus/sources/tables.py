"""Surfaces, points and zones made from the supplied tables, always in the same way.

``dense``: embeddings as a raster (row = vec_id, col = place, z = 100 times the value). ``sparse``: mean price of line items by
part group and month. ``pair``: the same from orders with even and odd keys, as a reference and a surface to be aligned.
``series``: the same by year. ``points``: events. ``zones``: five zones by row, of which 0 is stable ground.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.grid import clean


#: Prices are divided by a prime, so that means of a few prices don't end in a round digit.
SCALE = 997


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return e.select("row", "col", clean(100 * F.col("v").cast("double")).alias("z"))


def _cells(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    row = F.floor(F.col("l_partkey") / 20).cast("int").alias("row")
    col = F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 30).cast("int").alias("col")
    return items.select(row, col, F.col("l_extendedprice").alias("price"), *more)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("row", "col").agg((F.avg("price") / SCALE).alias("z"), F.count("*").alias("n"))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, z_ref, z_tba on common cells."""
    odd = F.col("l_orderkey") % 2
    half = lambda k: F.avg(F.when(F.col("odd") == k, F.col("price"))) / SCALE
    both = _cells(spark, sf_dir, odd.alias("odd")).groupBy("row", "col").agg(half(0).alias("z_ref"), half(1).alias("z_tba"))
    return both.where("z_ref is not null and z_tba is not null")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (start of the year), row, col, z. Cells are coarser than those of sparse, so that years overlap."""
    items = read(spark, sf_dir, "lineitem")
    row = F.floor(F.col("l_partkey") / 20).cast("int").alias("row")
    col = F.floor((F.dayofyear("l_shipdate") - 1) / 30).cast("int").alias("col")
    cells = items.select(F.date_trunc("year", "l_shipdate").alias("ts"), row, col, "l_extendedprice")
    return cells.groupBy("ts", "row", "col").agg((F.avg("l_extendedprice") / SCALE).alias("z"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3.6e9
    return e.select(F.col("event_id").alias("pid"), F.col("user_id").cast("double").alias("x"), hours.alias("y"), F.col("value").alias("z"))


def zones(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", (F.col("row") % 5).alias("zone"))
