"""Hypsometry: how elevation change depends on elevation, the areas of elevation bins, and filling of voids.

Differences are reference less surface. Bins are closed on the left. Bin tables have left, right, value and count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.numeric import natural_spline
from talus.grid import KEY
from talus.operators.stats import bin_index, linear_column, quantiles
from talus.plans.stencil import halo_tiles

_TABLE = "left double, right double, value double, count long"


def bin_edges(heights: DataFrame, bins: float | Sequence[float] = 50.0, kind: str = "fixed", column: str = "z") -> list[float]:
    """Edges of bins of a fixed width, a count, quantiles, or as given; all valid heights count, also where dh is missing."""
    if kind == "custom" or not np.isscalar(bins):
        return [float(b) for b in bins]
    ends = heights.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("there is no valid height")
    lo, hi = ends["lo"], ends["hi"]
    if kind == "fixed":
        return [float(v) for v in np.arange(lo, hi + bins + 1e-6, step=bins)]
    if kind == "count":
        return [float(v) for v in np.linspace(lo, hi + 1e-6 / bins, int(bins) + 1)]
    if kind == "quantile":
        q = quantiles(heights, [], column, {f"q{k}": k / int(bins) for k in range(int(bins) + 1)}).first()
        edges = [float(q[f"q{k}"]) for k in range(int(bins) + 1)]
        edges[-1] += 1e-6
        return edges
    raise ValueError("bins are fixed, count, quantile or custom")


def hypsometric_binning(df: DataFrame, bins: float | Sequence[float] = 50.0, kind: str = "fixed", quantile: float | None = 0.5) -> DataFrame:
    """The bin table of cells (z, dh): the median (or another quantile, or with None the mean) of dh by bin of z. Every bin
    has a row; empty ones have no value and a count of 0."""
    edges = bin_edges(df, bins, kind)
    spark = df.sparkSession
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, left double, right double")
    filled = df.where("dh is not null and z is not null").select("dh", bin_index(F.col("z"), edges).alias("bin")).where("bin is not null")
    if quantile is None:
        stat = filled.groupBy("bin").agg(F.avg("dh").alias("value"), F.count("*").alias("n"))
    else:
        stat = quantiles(filled, ["bin"], "dh", {"value": quantile})
    return table.join(F.broadcast(stat), "bin", "left").select("bin", "left", "right", "value", F.coalesce("n", F.lit(0)).alias("count"))


def _table(bins: DataFrame) -> pd.DataFrame:
    return bins.orderBy("left").toPandas()


def interpolate_bins(bins: DataFrame, method: str = "polynomial", count_threshold: int | None = None) -> DataFrame:
    """The bin table with missing values (and those of bins with too few counts) interpolated: ``linear``, or a cubic spline
    that is straight at its ends; beyond the known bins the nearest value holds."""
    t = _table(bins)
    mid, value = ((t["left"] + t["right"]) / 2).to_numpy(), t["value"].to_numpy(float)
    if count_threshold is not None:
        value = np.where(t["count"] < count_threshold, np.nan, value)
    good = np.isfinite(value)
    if not good.any():
        raise ValueError("no bin has a value")
    line = np.interp(mid, mid[good], value[good])
    if method == "polynomial" and good.sum() > 3:
        curve = natural_spline(mid[good], value[good], mid)
        line = np.where(np.isfinite(curve), curve, line)
    t["value"] = np.where(good, value, line)
    return bins.sparkSession.createDataFrame(t[["left", "right", "value", "count"]], _TABLE)


def fit_bins(bins: DataFrame, degree: int = 3, iterations: int = 1, count_threshold: int | None = None) -> DataFrame:
    """The bin table with a polynomial in its place; values over three standard deviations off are left out of a next fit."""
    t = _table(bins)
    mid, value = ((t["left"] + t["right"]) / 2).to_numpy(), t["value"].to_numpy(float)
    if count_threshold is not None:
        value = np.where(t["count"] < count_threshold, np.nan, value)
    good = np.isfinite(value)
    fitted = value
    for _ in range(iterations):
        fitted = np.polynomial.Polynomial.fit(mid[good], value[good], min(degree, int(good.sum()) - 1))(mid)
        off = np.abs(fitted - value)
        kept = good & ~(off > 3 * np.nanstd(fitted - value))
        if (kept == good).all():
            break
        good = kept
    t["value"] = fitted
    return bins.sparkSession.createDataFrame(t[["left", "right", "value", "count"]], _TABLE)


def hypsometry_area(bins: DataFrame, heights: DataFrame, cell_area: float, timeframe: str = "reference") -> DataFrame:
    """left, right and the area of cells by bin: at the time of the reference, of the other surface, or between them."""
    if timeframe not in ("reference", "nonreference", "mean"):
        raise ValueError("the timeframe is reference, nonreference or mean")
    t = _table(bins)
    mid = ((t["left"] + t["right"]) / 2).to_numpy()
    z = F.col("z")
    if timeframe != "reference":
        if t["value"].isna().any():
            raise ValueError("bins have missing values: interpolate them first")
        change = _extrapolated(z, mid, t["value"].to_numpy(float))
        z = z - (change / 2 if timeframe == "mean" else change)
    edges = [*t["left"], t["right"].iloc[-1]]
    counted = heights.where("z is not null").select(bin_index(z, edges).alias("bin")).where("bin is not null").groupBy("bin").count()
    table = bins.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(t["left"], t["right"], strict=True))], "bin int, left double, right double")
    return table.join(F.broadcast(counted), "bin", "left").select("left", "right", (F.coalesce("count", F.lit(0)) * float(cell_area)).alias("area"))


def _extrapolated(z, mid: np.ndarray, value: np.ndarray):
    """Linear interpolation that goes on beyond the ends."""
    if len(mid) < 2:
        return F.lit(float(value[0]))
    column = linear_column(z, mid, value)
    first, last = (value[1] - value[0]) / (mid[1] - mid[0]), (value[-1] - value[-2]) / (mid[-1] - mid[-2])
    low, high = float(value[0]) + (z - float(mid[0])) * float(first), float(value[-1]) + (z - float(mid[-1])) * float(last)
    return F.when(z < float(mid[0]), low).when(z > float(mid[-1]), high).otherwise(column)


def fill_hypsometric(df: DataFrame, bins: float = 50.0, kind: str = "fixed", inside: str | None = None) -> DataFrame:
    """df (z, dh) with missing dh filled from the median by elevation; ``inside`` is a condition on what is used and filled."""
    used = df.where(inside) if inside else df
    table = _table(interpolate_bins(hypsometric_binning(used, bins, kind), "linear"))
    model = linear_column(F.col("z"), (table["left"] + table["right"]) / 2, table["value"])
    fill = F.when(F.expr(inside), model) if inside else model
    return df.withColumn("dh", F.coalesce("dh", fill))


def fill_local_hypsometric(df: DataFrame, n_bins: int = 20, min_coverage: float = 0.2, count_threshold: int = 1) -> DataFrame:
    """df (z, dh, zone) with missing dh of zones (over 0) filled from each zone's own medians by elevation. Zones of which less
    than min_coverage is known stay as they are. All zones are binned in one pass; between known bins values are
    interpolated linearly, and beyond them the nearest holds."""
    stats = df.where("zone > 0 and z is not null").groupBy("zone").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.avg(F.when(F.col("dh").isNotNull(), 1.0).otherwise(0.0)).alias("share"))
    cells = df.join(stats.where(F.col("share") >= min_coverage), "zone", "left")
    width = F.greatest((F.col("hi") - F.col("lo")) / n_bins, F.lit(1e-9))
    cells = cells.withColumn("_w", width).withColumn("bin", F.when(F.col("lo").isNotNull() & F.col("z").isNotNull(), F.least(F.lit(n_bins - 1), F.floor((F.col("z") - F.col("lo")) / F.col("_w")).cast("int"))))
    medians = quantiles(cells.where("dh is not null and bin is not null"), ["zone", "bin"], "dh", {"m": 0.5}).where(F.col("n") >= count_threshold)
    curves = medians.groupBy("zone").agg(F.sort_array(F.collect_list(F.struct("bin", "m"))).alias("_curve"))  # at most n_bins a zone
    met = cells.join(curves, "zone", "left")
    place = (F.col("z") - F.col("lo")) / F.col("_w") - 0.5
    below = F.filter("_curve", lambda b: b["bin"] <= place)
    above = F.filter("_curve", lambda b: b["bin"] > place)
    p, q = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = p["m"] + (q["m"] - p["m"]) * (place - p["bin"]) / (q["bin"] - p["bin"])
    model = F.when(p.isNull(), q["m"]).when(q.isNull(), p["m"]).otherwise(between)
    return met.withColumn("dh", F.coalesce("dh", model)).select(*df.columns)


def regional_signal(df: DataFrame, n_bins: int = 20, min_coverage: float = 0.05) -> DataFrame:
    """How change depends on normalised elevation over all zones of df (z, dh, zone): each zone's mean by bin of its own
    range, scaled to 0..1 over its bins, then over zones by bin: the mean weighted by cells, median, deviation and quantiles."""
    stats = df.where("zone > 0 and z is not null").groupBy("zone").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.avg(F.when(F.col("dh").isNotNull(), 1.0).otherwise(0.0)).alias("share"))
    cells = df.where("dh is not null").join(stats.where((F.col("share") >= min_coverage) & (F.col("hi") > F.col("lo"))), "zone")
    index = F.least(F.lit(n_bins - 1), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins).cast("int"))
    by_zone = cells.groupBy("zone", index.alias("bin")).agg(F.avg("dh").alias("v"), F.count("*").alias("k"))
    ends = by_zone.groupBy("zone").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("b > a")
    scaled = by_zone.join(ends, "zone").withColumn("s", (F.col("v") - F.col("a")) / (F.col("b") - F.col("a")))
    plain = scaled.groupBy("bin").agg((F.sum(F.col("s") * F.col("k")) / F.sum("k")).alias("w_mean"), F.stddev_pop("s").alias("std"), F.sum("k").alias("count"))
    spread = quantiles(scaled, ["bin"], "s", {"median": 0.5, "sigma_lower": 0.1587, "sigma_upper": 0.8413, "2sigma_lower": 0.0228, "2sigma_upper": 0.9772})
    return plain.join(spread.drop("n"), "bin")


def fill_regional(df: DataFrame, signal: DataFrame | None = None, n_bins: int = 20, min_coverage: float = 0.1, min_range: float = 0.33, idealized: bool = False) -> DataFrame:
    """df (z, dh, zone) with missing dh of zones filled by the regional signal, which a weighted line fits to each zone's own
    bins: the fit is a handful of sums by zone. Zones known in part only below min_coverage or over less than min_range of
    their elevations stay as they are. With idealized all cells get the model."""
    signal = regional_signal(df, n_bins) if signal is None else signal
    stats = df.where("zone > 0 and z is not null").groupBy("zone").agg(
        F.min("z").alias("lo"), F.max("z").alias("hi"), F.avg(F.when(F.col("dh").isNotNull(), 1.0).otherwise(0.0)).alias("share"),
        F.min(F.when(F.col("dh").isNotNull(), F.col("z"))).alias("klo"), F.max(F.when(F.col("dh").isNotNull(), F.col("z"))).alias("khi"),
    )
    usable = stats.where((F.col("share") >= min_coverage) & (F.col("hi") > F.col("lo")) & ((F.col("khi") - F.col("klo")) >= min_range * (F.col("hi") - F.col("lo"))))
    cells = df.join(usable.select("zone", "lo", "hi"), "zone", "left")
    index = F.least(F.lit(n_bins - 1), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins).cast("int"))
    index = F.when(F.col("lo").isNotNull() & F.col("z").isNotNull(), index)
    cells = cells.withColumn("bin", index).join(F.broadcast(signal.select("bin", "w_mean")), "bin", "left")
    s = F.col("w_mean")
    sums = cells.where("dh is not null and w_mean is not null").groupBy("zone").agg(
        F.count("*").alias("n"), F.sum(s).alias("sx"), F.sum("dh").alias("sy"), F.sum(s * s).alias("sxx"), F.sum(s * F.col("dh")).alias("sxy")
    )
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    lines = sums.withColumn("slope", F.when(det > 1e-12, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).otherwise(0.0))
    lines = lines.withColumn("level", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).select("zone", "slope", "level")
    model = F.col("slope") * s + F.col("level")
    met = cells.join(lines, "zone", "left")
    return met.withColumn("dh", F.coalesce(model, "dh") if idealized else F.coalesce("dh", model)).select(*df.columns)


def closed_cells(df: DataFrame, size: int, column: str = "dh") -> DataFrame:
    """Cells (row, col) that are valid or lie in gaps between valid cells that a square of that size can't enter (a binary
    closing). Cells outside the raster are void."""
    before, after = size - 1 - size // 2, size // 2

    def moving(v: np.ndarray, first: int, last: int, merge) -> np.ndarray:
        """v merged over the squares from first to last around each cell; voids lie outside."""
        wide = np.pad(v, size)
        for axis in (0, 1):
            wide = merge.reduce([np.roll(wide, -k, axis) for k in range(first, last + 1)])
        return wide[size:-size, size:-size]

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        grown = moving(~np.isnan(z), -before, after, np.logical_or)
        return {"kept": np.where(moving(grown, -after, before, np.logical_and), 1.0, np.nan)}

    cells = df.select(*KEY, F.col(column).alias("z"))
    return halo_tiles(cells, kernel, 2 * size, ["kept"], max(256, 4 * size)).where("kept is not null").select(*KEY)


def fill_idw(df: DataFrame, radius: int = 10, column: str = "dh", extrapolate: bool = True, force: bool = False) -> DataFrame:
    """df with missing values filled from valid cells within a radius, weighted by inverse distance. Voids are spread to the
    cells around them and met there, so the work grows with the voids and the radius only.

    Without extrapolate only gaps that a square one smaller than the radius can't enter are filled; valid cells always stay.
    With force, what is missing then becomes the median of the valid cells (and stays missing where there is none)."""
    if not extrapolate and radius > 1:
        inner = closed_cells(df, radius - 1, column).withColumn("_in", F.lit(True))
        out = fill_idw(df, radius, column).withColumnRenamed(column, "_all").join(df.select(*KEY, column), KEY).join(inner, KEY, "left")
        out = out.withColumn(column, F.when(F.col("_in"), F.col("_all")).otherwise(F.col(column))).select(*df.columns)
        return _median_filled(out, df, column) if force else out
    if force:
        return _median_filled(fill_idw(df, radius, column), df, column)
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j <= radius * radius]
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1 / (i * i + j * j) ** 0.5).alias("w")) for i, j in offsets)))
    voids = df.where(F.col(column).isNull()).select(F.col("row").alias("r0"), F.col("col").alias("c0"), around.alias("o"))
    voids = voids.select("r0", "c0", (F.col("r0") + F.col("o.i")).alias("row"), (F.col("c0") + F.col("o.j")).alias("col"), F.col("o.w").alias("w"))
    met = voids.join(df.where(F.col(column).isNotNull()).select(*KEY, F.col(column).alias("_v")), KEY)
    filled = met.groupBy(F.col("r0").alias("row"), F.col("c0").alias("col")).agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("_fill"))
    return df.join(filled, KEY, "left").withColumn(column, F.coalesce(column, "_fill")).drop("_fill").select(*df.columns)


def _median_filled(out: DataFrame, df: DataFrame, column: str) -> DataFrame:
    found = quantiles(df, [], column, {"m": 0.5}).first()
    return out if found is None else out.withColumn(column, F.coalesce(column, F.lit(float(found["m"]))))
