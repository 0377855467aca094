"""Surfaces from streams of points, as an extension: batches add to a table of sums by cell, from which the surface is read.

Sums and counts can be merged, so a batch costs its own points and never a scan of old ones. Each batch writes under its own
number and replaces what an earlier try of it wrote, so a restarted query counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talus.grid import Grid


def cell_sums(points: DataFrame, grid: Grid) -> DataFrame:
    """row, col, total and n of points by cell."""
    row, col = grid.place(F.col("x"), F.col("y"))
    cells = points.where("z is not null").select(F.round(row).cast("int").alias("row"), F.round(col).cast("int").alias("col"), "z")
    return cells.groupBy("row", "col").agg(F.sum("z").alias("total"), F.count("*").alias("n"))


def follow(points: DataFrame, grid: Grid, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start adding a stream of points (x, y, z) to the sums under path."""

    def add(batch: DataFrame, number: int) -> None:
        cell_sums(batch, grid).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def surface(spark: SparkSession, path: str) -> DataFrame:
    """row, col, z and n of everything that has arrived."""
    sums = spark.read.parquet(path).groupBy("row", "col").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    return sums.select("row", "col", (F.col("t") / F.col("n")).alias("z"), "n")
