"""Time series of surfaces: differences to a reference epoch, their series by interval, and cumulative series.

A collection is one long table (ts, row, col, z); it is sorted by time wherever order matters.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.grid import KEY
from talus.operators import hypso


def subtract_epochs(long: DataFrame, reference_ts) -> DataFrame:
    """start_ts, end_ts, row, col and dh = reference less surface for every other epoch; a surface from after the reference
    starts at the reference."""
    ref = long.where(F.col("ts") == F.lit(reference_ts)).select(*KEY, F.col("z").alias("_ref"))
    both = long.where(F.col("ts") != F.lit(reference_ts)).join(ref, KEY)
    t = F.lit(reference_ts).cast("timestamp")
    return both.select(F.least("ts", t).alias("start_ts"), F.greatest("ts", t).alias("end_ts"), *KEY, (F.col("_ref") - F.col("z")).alias("dh"))


def dh_series(ddems: DataFrame, cell_area: float, mask: DataFrame | None = None, missing_ok: bool = False) -> DataFrame:
    """start_ts, end_ts, mean dh, and the area it stands for; intervals with missing cells are refused unless allowed."""
    cells = ddems if mask is None else ddems.join(mask.select(*KEY).distinct(), KEY, "left_semi")
    out = cells.groupBy("start_ts", "end_ts").agg(F.avg("dh").alias("dh"), (F.count("*") * float(cell_area)).alias("area"), F.sum(F.col("dh").isNull().cast("int")).alias("missing"))
    if not missing_ok and not out.where("missing > 0").isEmpty():
        raise ValueError("some differences have missing cells: fill them, or allow them")
    return out.select("start_ts", "end_ts", "dh", "area")


def dv_series(series: DataFrame) -> DataFrame:
    """start_ts, end_ts, dv: the mean change times its area."""
    return series.select("start_ts", "end_ts", (F.col("dh") * F.col("area")).alias("dv"))


def cumulative_series(series: DataFrame, reference_ts, value: str = "dh") -> DataFrame:
    """ts and the change since the first epoch. Differences to the reference become levels (0 at the reference), which are
    sorted by time and anchored to the first."""
    t = F.lit(reference_ts).cast("timestamp")
    other = F.when(F.col("start_ts") == t, F.col("end_ts")).otherwise(F.col("start_ts"))
    levels = series.select(other.alias("ts"), (-F.col(value)).alias("v"))
    zero = series.sparkSession.range(1).select(t.alias("ts"), F.lit(0.0).alias("v"))
    w = Window.orderBy("ts")  # one row an epoch
    return levels.unionByName(zero).select("ts", (F.col("v") - F.first("v").over(w)).alias(value))


@dataclass
class DDem:
    """A difference of two surfaces (row, col, dh and what its fill needs), with the times it lies between."""

    df: DataFrame
    start_time: datetime
    end_time: datetime
    error: float | None = None
    fill_method: str | None = None

    @property
    def time(self) -> timedelta:
        return self.end_time - self.start_time

    def filled(self) -> DataFrame | None:
        """The cells, if none is missing."""
        return None if not self.df.where("dh is null").isEmpty() else self.df

    def interpolate(self, method: str = "idw", **options) -> DDem:
        fills = {"idw": hypso.fill_idw, "local_hypsometric": hypso.fill_local_hypsometric, "regional_hypsometric": hypso.fill_regional}
        if method not in fills:
            raise NotImplementedError(f"unknown method {method}; known are {', '.join(fills)}")
        return DDem(fills[method](self.df, **options), self.start_time, self.end_time, self.error, method)


@dataclass
class Collection:
    """Surfaces of several times (ts, row, col, z) with a reference time, the cell area, and outlines by name."""

    df: DataFrame
    reference_ts: datetime
    cell_area: float = 1.0
    outlines: DataFrame | None = None

    def timestamps(self) -> list[datetime]:
        return [r.ts for r in self.df.select("ts").distinct().orderBy("ts").collect()]

    def subtract(self) -> DataFrame:
        return subtract_epochs(self.df, self.reference_ts)

    def mask(self, where: str | None = None) -> DataFrame | None:
        """Cells of the outlines (of any time) that meet a condition on their attributes."""
        if self.outlines is None:
            return None
        return (self.outlines.where(where) if where else self.outlines).select(*KEY).distinct()

    def interpolate(self, method: str = "idw", **options) -> list[DDem]:
        """The differences of the epochs, one by one, their missing cells filled."""
        found = self.subtract()
        times = [(r.start_ts, r.end_ts) for r in found.select("start_ts", "end_ts").distinct().orderBy("start_ts", "end_ts").collect()]
        parts = [(found.where((F.col("start_ts") == a) & (F.col("end_ts") == b)).drop("start_ts", "end_ts"), a, b) for a, b in times]
        return [DDem(df, a, b).interpolate(method, **options) for df, a, b in parts]

    def dh(self, where: str | None = None, missing_ok: bool = False) -> DataFrame:
        return dh_series(self.subtract(), self.cell_area, self.mask(where), missing_ok)

    def dv(self, where: str | None = None, missing_ok: bool = False) -> DataFrame:
        return dv_series(self.dh(where, missing_ok))

    def cumulative(self, kind: str = "dh", where: str | None = None, missing_ok: bool = False) -> DataFrame:
        if kind not in ("dh", "dv"):
            raise ValueError("the kind is dh or dv")
        return cumulative_series(self.dh(where, missing_ok) if kind == "dh" else self.dv(where, missing_ok), self.reference_ts, kind)
