"""Rasters as tables: cells (row INT, col INT, z DOUBLE) with a georeference beside them.

Missing heights have one spelling, NULL; NaN, infinities and nodata values become NULL when cells are loaded. Rows grow
southward, columns eastward. A table need not hold all cells of its grid: an absent cell is like a NULL one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["row", "col"]


@dataclass(frozen=True)
class Grid:
    """x = a col + b row + c and y = d col + e row + f for the upper left corner of a cell."""

    height: int | None = None
    width: int | None = None
    transform: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    crs: str | None = None
    vcrs: str | None = None
    nodata: float | None = None
    area_or_point: str | None = "Area"

    @property
    def resolution(self) -> float:
        """Pixel size; attributes that need square pixels ask for it."""
        a, b, _, d, e, _ = self.transform
        if abs(abs(a) - abs(e)) > 1e-9 * abs(a) or b or d:
            raise ValueError("pixels must be square and aligned with the axes")
        return abs(a)

    @property
    def cell_area(self) -> float:
        a, b, _, d, e, _ = self.transform
        return abs(a * e - b * d)

    def _offset(self) -> float:
        return 0.0 if self.area_or_point == "Point" else 0.5

    def x(self, row: Column, col: Column, offset: float | None = None) -> Column:
        a, b, c, *_ = self.transform
        o = self._offset() if offset is None else offset
        return F.lit(a) * (col + F.lit(o)) + F.lit(b) * (row + F.lit(o)) + F.lit(c)

    def y(self, row: Column, col: Column, offset: float | None = None) -> Column:
        *_, d, e, f = self.transform
        o = self._offset() if offset is None else offset
        return F.lit(d) * (col + F.lit(o)) + F.lit(e) * (row + F.lit(o)) + F.lit(f)

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional row and column of a point, so that whole numbers are where cells' values stand."""
        a, b, c, d, e, f = self.transform
        det = a * e - b * d
        col = (F.lit(e / det) * (x - c)) - (F.lit(b / det) * (y - f)) - self._offset()
        row = (F.lit(a / det) * (y - f)) - (F.lit(d / det) * (x - c)) - self._offset()
        return row, col

    def moved(self, dx: float, dy: float) -> Grid:
        """The grid translated in its own units."""
        a, b, c, d, e, f = self.transform
        return replace(self, transform=(a, b, c + dx, d, e, f + dy))

    def with_vcrs(self, vcrs: str | None) -> Grid:
        return replace(self, vcrs=vcrs)

    def sized(self, df: DataFrame) -> Grid:
        """The grid with a height and a width; those that are not known reach to the last cell of df."""
        if self.height is not None and self.width is not None:
            return self
        last = df.agg(F.max("row"), F.max("col")).first()
        height, width = (n if n is not None else 1 + (-1 if k is None else k) for n, k in zip((self.height, self.width), last, strict=True))
        return replace(self, height=height, width=width)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east and north of a grid of known height and width."""
        if self.height is None or self.width is None:
            raise ValueError("a grid without height and width has no bounds")
        a, b, c, d, e, f = self.transform
        ends = [(a * j + b * i + c, d * j + e * i + f) for i in (0, self.height) for j in (0, self.width)]
        xs, ys = zip(*ends, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def intersection(self, other: Grid) -> tuple[float, float, float, float] | None:
        """The bounds that two grids share; None if they don't meet. Both must have the same horizontal reference."""
        if self.crs != other.crs:
            raise ValueError(f"the grids have different references, {self.crs} and {other.crs}")
        (w, s, e, n), (w2, s2, e2, n2) = self.bounds, other.bounds
        shared = max(w, w2), max(s, s2), min(e, e2), min(n, n2)
        return shared if shared[0] < shared[2] and shared[1] < shared[3] else None

    def window(self, bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
        """First and last row and column, the last excluded, of the cells that bounds touch; for grids along the axes."""
        a, b, c, d, e, f = self.transform
        if b or d:
            raise ValueError("windows are for grids along the axes")
        west, south, east, north = bounds
        cols, rows = sorted(((west - c) / a, (east - c) / a)), sorted(((south - f) / e, (north - f) / e))
        return math.floor(rows[0] + 1e-9), math.ceil(rows[1] - 1e-9), math.floor(cols[0] + 1e-9), math.ceil(cols[1] - 1e-9)

    def metric_crs(self) -> str:
        """The code of the UTM zone (beyond its latitudes, of the polar projection) that a grid in degrees has its middle in."""
        west, south, east, north = self.bounds
        lon, lat = (west + east) / 2, (south + north) / 2
        if not (-180 <= lon <= 180 and -90 <= lat <= 90):
            raise ValueError("the grid is not in degrees")
        if not -80 <= lat <= 84:
            return "EPSG:32661" if lat > 0 else "EPSG:32761"
        return f"EPSG:{(32600 if lat >= 0 else 32700) + min(60, int((lon + 180) // 6) + 1)}"


def clean(z: Column, nodata: float | None = None) -> Column:
    """z as a double with one spelling of missing."""
    z = z.cast("double")
    bad = F.isnan(z) | (F.abs(z) == float("inf"))
    if nodata is not None:
        bad = bad | (z == nodata)
    return F.when(~bad, z)


def from_array(spark: SparkSession, values, nodata: float | None = None) -> DataFrame:
    """Cells of a two-dimensional array (for small rasters; large ones are read from files)."""
    array = np.asarray(np.ma.filled(np.ma.asarray(values, float), np.nan))
    if array.ndim != 2:
        raise ValueError("a raster has one band of two dimensions")
    rows, cols = np.indices(array.shape)
    data = list(zip(rows.ravel().tolist(), cols.ravel().tolist(), array.ravel().tolist(), strict=True))
    df = spark.createDataFrame(data, "row int, col int, z double")
    return df.withColumn("z", clean(F.col("z"), nodata))


def to_array(df: DataFrame, height: int, width: int, column: str = "z") -> np.ndarray:
    """The array of a small raster; missing cells are NaN."""
    out = np.full((height, width), np.nan)
    for r in df.select("row", "col", column).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


def from_nested(df: DataFrame, column: str = "values") -> DataFrame:
    """Cells of a column ARRAY<ARRAY<DOUBLE>> with one raster a row; other columns stay."""
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, F.posexplode(column).alias("row", "_cells"))
    cells = rows.select(*others, "row", F.posexplode("_cells").alias("col", "z"))
    return cells.withColumn("z", clean(F.col("z")))


def downsample(df: DataFrame, factor: int) -> DataFrame:
    """Every factor-th row and column."""
    picked = df.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0))
    return picked.withColumns({"row": (F.col("row") / factor).cast("int"), "col": (F.col("col") / factor).cast("int")})


def crop(df: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Rows row0 to row1 and columns col0 to col1, ends excluded; file statistics prune what lies outside."""
    return df.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))


def subtract(left: DataFrame, right: DataFrame, out: str = "dh") -> DataFrame:
    """left - right on common cells."""
    b = right.select(*KEY, F.col("z").alias("_b"))
    return left.join(b, KEY).select(*KEY, (F.col("z") - F.col("_b")).alias(out))
