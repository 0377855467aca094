"""Masks, subsets and random samples of cells and points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.grid import KEY


def include(df: DataFrame, mask: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Cells that the mask holds."""
    return df.join(mask.select(*keys).distinct(), keys, "left_semi")


def exclude(df: DataFrame, mask: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Cells that the mask does not hold."""
    return df.join(mask.select(*keys), keys, "left_anti")


def masked(df: DataFrame, inside: DataFrame | None = None, outside: DataFrame | None = None, column: str = "z", keep_shape: bool = False) -> DataFrame:
    """Values inside one mask and not in the other; the rest goes, or becomes NULL with keep_shape."""
    chosen = df if inside is None else include(df, inside)
    chosen = chosen if outside is None else exclude(chosen, outside)
    if not keep_shape:
        return chosen.where(F.col(column).isNotNull())
    return df.drop(column).join(chosen.select(*KEY, column), KEY, "left")


def set_mask(df: DataFrame, mask: DataFrame, column: str = "z") -> DataFrame:
    """df with NULL in the cells of the mask."""
    flagged = df.join(mask.select(*KEY).distinct().withColumn("_m", F.lit(True)), KEY, "left")
    return flagged.withColumn(column, F.when(F.col("_m").isNull(), F.col(column))).drop("_m")


def union(*masks: DataFrame) -> DataFrame:
    """Cells of any mask."""
    out = masks[0].select(*KEY)
    for m in masks[1:]:
        out = out.union(m.select(*KEY))
    return out.distinct()


def circle(df: DataFrame, row: float, col: float, radius: float) -> DataFrame:
    """Cells nearer to a centre than the radius."""
    return df.where(F.pow(F.col("row") - row, 2) + F.pow(F.col("col") - col, 2) < radius * radius)


def ring(df: DataFrame, row: float, col: float, inner: float, outer: float) -> DataFrame:
    """Cells in the outer circle that are not in the inner one."""
    d = F.pow(F.col("row") - row, 2) + F.pow(F.col("col") - col, 2)
    return df.where((d < outer * outer) & ~(d < inner * inner))


def sample(df: DataFrame, n: float, seed: int = 42, keys: list[str] = KEY) -> DataFrame:
    """A sample that depends on keys and seed only: a share of the rows (n <= 1), or n rows that come first by hash. Keys tell
    rows apart. Rows are counted first, and a threshold on the hash thins them to little more than n before they are sorted."""
    score = F.xxhash64(*keys, F.lit(seed))
    if n == 1:
        return df
    if n < 1:
        return df.where(F.pmod(score, F.lit(1 << 30)) < int(n * (1 << 30)))
    n, rows = int(n), df.count()
    if rows <= n:
        return df
    share = (n + 10 * math.sqrt(n) + 100) / rows
    thin = df.where(score <= -(1 << 63) + int(share * 2**64)) if share < 1 else df
    return thin.orderBy(score, *keys).limit(n)


def inside_polygon(df: DataFrame, ring_xy: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Rows whose point lies in a polygon, by counting crossings of a ray."""
    px, py = F.col(x), F.col(y)
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring_xy, ring_xy[1:] + ring_xy[:1], strict=True):
        if ay == by:
            continue
        spans = ((F.lit(float(ay)) > py) != (F.lit(float(by)) > py)) & (px < (bx - ax) / (by - ay) * (py - ay) + ax)
        crossings = crossings + spans.cast("int")
    return df.where(crossings % 2 == 1)


def proximity(df: DataFrame, targets: DataFrame, radius: int) -> DataFrame:
    """row, col and the distance in cells to the nearest target cell within a radius (NULL beyond): targets are spread to
    the cells around them, so the work is bounded by the radius."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets)))
    near = targets.select("row", "col", around.alias("o")).select(
        (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.sqrt(F.pow("o.i", 2) + F.pow("o.j", 2)).alias("d")
    )
    return df.select("row", "col").join(near.groupBy("row", "col").agg(F.min("d").alias("distance")), KEY, "left")
