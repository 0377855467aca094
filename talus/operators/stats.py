"""Robust statistics and multi-variable binning.

Quantiles are exact and distributed: a mergeable sketch gives brackets that are sure to hold the wanted ranks, values below
and above the brackets are only counted, and those within (a thousandth of a group) are counted by value and ranked. Nothing
depends on how rows are parted. They interpolate linearly.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NFACT = 1.4826
STATISTICS = ["mean", "median", "max", "min", "sum", "sumofsquares", "90thpercentile", "le90", "nmad", "rmse", "std", "standarddeviation", "validcount", "totalcount", "percentagevalidpoints"]


#: Half the width of a bracket and the error of the sketch, as shares of a group's rows. The error is a tenth of the width.
_SLACK, _ERROR = 0.0005, 0.00005


def quantiles(df: DataFrame, by: Sequence[str], column: str, probs: dict[str, float]) -> DataFrame:
    """by, n (values that are not null) and one column a probability. Groups without values are absent.

    A bracket goes from the sketch's quantile a little below a probability to the one a little above. Beside the values in it
    the largest value below and the smallest above are known, so ranks that rounding puts just outside are held too."""
    by = list(by)
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    levels = sorted({float(p) for p in probs.values()})
    ends = [min(1.0, max(0.0, p + d)) for p in levels for d in (-_SLACK, _SLACK)]
    sketch = rows.groupBy(*by).agg(F.percentile_approx("_v", ends, round(1 / _ERROR)).alias("_ends"), F.count("*").alias("n"))
    met = _with_group(rows, sketch, by)
    side = [F.when(F.col("_v") < F.col("_ends")[2 * k], -1).when(F.col("_v") > F.col("_ends")[2 * k + 1], 1).otherwise(0).alias(f"_s{k}") for k in range(len(levels))]
    # -1 and 1: all values below and above a bracket; 0: one value in it
    sided = met.select(*by, "n", "_v", *side)
    spots = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_s{k}").alias("s"), F.when(F.col(f"_s{k}") == 0, F.col("_v")).alias("v")) for k in range(len(levels)))))
    spread = sided.select(*by, "n", "_v", spots.alias("_at")).select(*by, "n", "_v", "_at.*")
    counts = spread.groupBy(*by, "k", "s", "v").agg(F.count("*").alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.max("n").alias("n"))
    upto = Window.partitionBy(*by, "k").orderBy("s", "v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_to", F.sum("_k").over(upto)).withColumn("_from", F.col("_to") - F.col("_k"))

    def at(k: int, index: Column) -> Column:
        # below a bracket the last rank is known, above it the first
        first, last = F.when(F.col("s") == -1, F.col("_to") - 1).otherwise(F.col("_from")), F.when(F.col("s") == 1, F.col("_from") + 1).otherwise(F.col("_to"))
        value = F.when(F.col("s") == -1, F.col("_high")).otherwise(F.col("_low"))
        return F.max(F.when((F.col("k") == k) & (first <= index) & (index < last), value))

    out = []
    for name, p in probs.items():
        k = levels.index(float(p))
        h = (F.col("n") - 1) * F.lit(float(p))
        low, high = at(k, F.floor(h)), at(k, F.ceil(h))
        part = F.max(h - F.floor(h))
        out.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *out).where("n is not null")


def _with_group(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of other, which has a row for each group (one row, of no key, without groups)."""
    if not by:
        return df.crossJoin(F.broadcast(other))
    renamed = other.select(*(F.col(b).alias(f"_g{k}") for k, b in enumerate(by)), *(c for c in other.columns if c not in by))
    cond = [F.col(b).eqNullSafe(F.col(f"_g{k}")) for k, b in enumerate(by)]
    return df.join(renamed, cond).drop(*(f"_g{k}" for k in range(len(by))))


def nmad(df: DataFrame, column: str, by: Sequence[str] = (), nfact: float = NFACT) -> DataFrame:
    """by, n, median and nmad: nfact times the median absolute deviation from the median."""
    middle = quantiles(df, by, column, {"median": 0.5})
    return _with_group(middle, _deviation(df, column, by, middle, nfact), by).select(*by, "n", "median", "nmad")


def _deviation(df: DataFrame, column: str, by: Sequence[str], middle: DataFrame, nfact: float = NFACT) -> DataFrame:
    """by and nmad, from the medians."""
    spread = _with_group(df.where(F.col(column).isNotNull()), middle.select(*by, F.col("median").alias("_median")), by).withColumn("_d", F.abs(F.col(column) - F.col("_median")))
    return quantiles(spread, by, "_d", {"_mad": 0.5}).select(*by, (F.col("_mad") * nfact).alias("nmad"))


def statistics(df: DataFrame, column: str, names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The named statistics of a column, by group. le90: half the spread between the 5 % and 95 % quantiles, centred."""
    names = list(names or STATISTICS)
    unknown = [n for n in names if n not in STATISTICS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}; known are {STATISTICS}")
    c = F.col(column)
    plain = {
        "mean": F.avg(c),
        "max": F.max(c),
        "min": F.min(c),
        "sum": F.sum(c),
        "sumofsquares": F.sum(c * c),
        "rmse": F.sqrt(F.avg(c * c)),
        "std": F.stddev_pop(c),
        "standarddeviation": F.stddev_pop(c),
        "validcount": F.count(c),
        "totalcount": F.count(F.lit(1)),
        "percentagevalidpoints": 100.0 * F.count(c) / F.count(F.lit(1)),
    }
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), *(plain[n].alias(n) for n in names if n in plain))
    probs = {"median": 0.5, "90thpercentile": 0.9, "_q05": 0.05, "_q95": 0.95}
    wanted = {k: p for k, p in probs.items() if k in names or (k[:2] == "_q" and "le90" in names) or (k == "median" and "nmad" in names)}
    if wanted:
        found = quantiles(df, by, column, wanted).drop("n")
        out = _left(out, found, by)
        if "nmad" in names:
            out = _left(out, _deviation(df, column, by, found), by)
    if "le90" in names:
        out = out.withColumn("le90", (F.col("_q95") - F.col("_q05")) / 2)
    return out.select(*by, *names)


def _left(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return a.join(F.broadcast(b), F.lit(True), "left")
    renamed = b.select(*(F.col(x).alias(f"_g{k}") for k, x in enumerate(by)), *(c for c in b.columns if c not in by))
    return a.join(renamed, [F.col(x).eqNullSafe(F.col(f"_g{k}")) for k, x in enumerate(by)], "left").drop(*(f"_g{k}" for k in range(len(by))))


# bins


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin of x among rising edges; the last bin holds its right edge; NULL outside."""
    e = [float(v) for v in edges]
    steps = np.diff(e)
    if len(e) > 2 and np.allclose(steps, steps[0], rtol=1e-12, atol=0):
        raw = F.floor((x - e[0]) / float(steps[0])).cast("int")
        # least() and greatest() pass over nulls, so the range is asked first
        index = F.when((x >= e[0]) & (x <= e[-1]), F.least(F.lit(len(e) - 2), F.greatest(F.lit(0), raw)))
        # rounding may put values next to an edge into the bin beside it: the edges decide
        low = F.element_at(F.array(*map(F.lit, e)), index + 1)
        high = F.element_at(F.array(*map(F.lit, e)), index + 2)
        return F.when(x < low, index - 1).when((x >= high) & (index < len(e) - 2), index + 1).otherwise(index)
    inside = F.size(F.filter(F.array(*map(F.lit, e)), lambda v: v <= x)) - 1
    return F.when((x >= e[0]) & (x <= e[-1]), F.least(inside, F.lit(len(e) - 2)))


def _edge(index: Column, edges: Sequence[float], shift: int) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in edges)), index + 1 + shift)


def bin_edges(df: DataFrame, value: str, bins: dict[str, Sequence[float] | int] | Sequence[str], ranges: dict[str, tuple[float, float]] | None = None) -> dict[str, Sequence[float]]:
    """Edges for each variable: as given, or so many bins of equal width (10 for bare names) over its range, which is as given
    or that of the rows of which the value and all variables are known. A variable without any such row raises."""
    wanted = dict(bins) if isinstance(bins, dict) else {n: 10 for n in bins}
    ranges = ranges or {}
    open_ended = [n for n, b in wanted.items() if isinstance(b, int) and n not in ranges]
    ends = {}
    if open_ended:
        known = df.select(value, *wanted).dropna()
        row = known.agg(*(f(n).alias(f"{k}_{i}") for i, n in enumerate(open_ended) for k, f in (("lo", F.min), ("hi", F.max)))).first()
        if row["lo_0"] is None:
            raise ValueError("no row has all variables")
        ends = {n: (float(row[f"lo_{i}"]), float(row[f"hi_{i}"])) for i, n in enumerate(open_ended)}
    out: dict[str, Sequence[float]] = {}
    for n, b in wanted.items():
        if isinstance(b, int):
            lo, hi = ranges.get(n) or ends[n]
            out[n] = [float(v) for v in np.linspace(lo, hi, b + 1)] if hi > lo else [lo - 0.5, lo + 0.5]
        else:
            out[n] = b
    return out


def nd_binning(
    df: DataFrame,
    value: str,
    edges: dict[str, Sequence[float] | int] | Sequence[str],
    statistics: dict[str, Callable[[Column], Column]] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Count, nanmedian and nmad of a value for every variable's bins, every pair's, and all together.

    edges are edges, numbers of bins, or bare names, as in bin_edges. statistics are more aggregates of the value by name, as
    functions of its column (``{"mean": F.avg}``); they may not take the name of a variable or of another column.

    Columns: nd (how many variables the bins have), for each variable its bin as struct (left, right), NULL where it takes no
    part, count, nanmedian, nmad. Empty bins are absent. All sets of variables are counted in one pass over exploded keys.
    """
    edges = bin_edges(df, value, edges, ranges)
    names, more = list(edges), statistics or {}
    taken = {"nd", "count", "nanmedian", "nmad", *names} & set(more)
    if taken:
        raise ValueError(f"statistics have names of other columns: {sorted(taken)}")
    sets = [s for k in sorted({1, 2, len(names)} & set(range(1, len(names) + 1))) for s in itertools.combinations(range(len(names)), k)]
    idx = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_value"), *(bin_index(F.col(n), edges[n]).alias(f"_b{k}") for k, n in enumerate(names)))
    keys = [F.struct(F.lit(len(s)).alias("nd"), *(F.col(f"_b{k}").alias(f"_b{k}") if k in s else F.lit(None).cast("int").alias(f"_b{k}") for k in range(len(names)))) for s in sets]
    valid = [F.when(sum((F.col(f"_b{k}").isNull().cast("int") for k in s), F.lit(0)) == 0, key) for s, key in zip(sets, keys, strict=True)]
    rows = idx.select("_value", F.explode(F.filter(F.array(*valid), lambda k: k.isNotNull())).alias("_key"))
    rows = rows.select("_value", "_key.*")
    by = ["nd", *(f"_b{k}" for k in range(len(names)))]
    stat = nmad(rows, "_value", by)
    bins = [F.when(F.col(f"_b{k}").isNotNull(), F.struct(_edge(F.col(f"_b{k}"), edges[n], 0).alias("left"), _edge(F.col(f"_b{k}"), edges[n], 1).alias("right"))).alias(n) for k, n in enumerate(names)]
    if more:
        stat = _left(stat, rows.groupBy(*by).agg(*(f(F.col("_value")).alias(f"_s{k}") for k, f in enumerate(more.values()))), by)
    return stat.select("nd", *bins, F.col("n").alias("count"), F.col("median").alias("nanmedian"), "nmad", *(F.col(f"_s{k}").alias(n) for k, n in enumerate(more)))


def parse_interval(text: str) -> tuple[float, float]:
    """(left, right) of text like ``[a, b)``."""
    m = re.fullmatch(r"\s*[\[(]\s*([^,\s]+)\s*,\s*([^,\s]+)\s*[\])]\s*", text)
    if not m:
        raise ValueError(f"no interval: {text!r}")
    return float(m[1]), float(m[2])


def interval_column(text: Column) -> Column:
    """The same on a column, as struct (left, right)."""
    part = lambda k: F.regexp_extract(text, r"[\[(]\s*([^,\s]+)\s*,\s*([^,\s\])]+)", k).cast("double")
    return F.struct(part(1).alias("left"), part(2).alias("right"))


def _interval_index(x: Column, ends: Sequence[tuple[float, float]]) -> Column:
    """The number of the interval (left, right) that holds x (left <= x < right), NULL where none does. Intervals are sorted and
    don't overlap."""
    left, right = (np.array([e[k] for e in ends], float) for k in (0, 1))

    @F.pandas_udf(T.IntegerType())
    def find(v: pd.Series) -> pd.Series:
        a = v.to_numpy(float, na_value=np.nan)
        at = np.searchsorted(left, a, "right") - 1
        inside = (at >= 0) & (a < right[np.maximum(at, 0)])
        return pd.Series(np.where(inside, at, -1)).astype("Int32").where(inside)

    return find(x.cast("double"))


def perbin_lookup(df: DataFrame, bins: DataFrame, variables: Sequence[str], statistic: str = "nanmedian", min_count: int = 0, max_bins: int = 100_000) -> DataFrame:
    """df with the statistic of the bin that its variables fall into (left <= x < right), NULL where there is none.

    Each variable's distinct intervals (at most max_bins, else this raises) become numbers by binary search, and the bin table is
    met by equality; it is broadcast if it has at most max_bins rows. Intervals of one variable mustn't overlap."""
    nd = len(variables)
    table = bins.where((F.col("nd") == nd) & (F.col("count") > min_count)).select(*(F.col(v).alias(f"_i{k}") for k, v in enumerate(variables)), F.col(statistic).alias("_s"))
    out, keys = df, []
    for k, v in enumerate(variables):
        found = table.select(f"_i{k}.left", f"_i{k}.right").where("left is not null and right is not null").distinct().limit(max_bins + 1).collect()
        ends = sorted((float(r[0]), float(r[1])) for r in found)
        if len(ends) > max_bins:
            raise ValueError(f"{v} has more than {max_bins} bins")
        if any(a[1] > b[0] for a, b in itertools.pairwise(ends)):
            raise ValueError(f"bins of {v} overlap")
        out = out.withColumn(f"_n{k}", _interval_index(F.col(v), ends) if ends else F.lit(None).cast("int"))
        table = table.withColumn(f"_m{k}", _interval_index(F.col(f"_i{k}.left"), ends) if ends else F.lit(None).cast("int"))
        keys.append(F.col(f"_n{k}") == F.col(f"_m{k}"))
    small = table.limit(max_bins + 1).count() <= max_bins
    table = table.drop(*(f"_i{k}" for k in range(nd)))
    joined = out.join(F.broadcast(table) if small else table, keys, "left")
    return joined.drop(*(f"_{c}{k}" for k in range(nd) for c in "nm")).withColumnRenamed("_s", statistic)


def linear_column(x: Column, at: Sequence[float], values: Sequence[float]) -> Column:
    """Piecewise linear interpolation through points, constant beyond the ends."""
    pts = [(float(a), float(v)) for a, v in zip(at, values, strict=True) if v is not None and np.isfinite(v)]
    if not pts:
        return F.lit(None).cast("double")
    out = F.when(x <= pts[0][0], F.lit(pts[0][1]))
    for (a, v), (b, w) in itertools.pairwise(pts):
        out = out.when(x <= b, F.lit(v) + (x - a) * ((w - v) / (b - a)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(pts[-1][1])))


class BinInterpolator:
    """A statistic between bins: multilinear between bin centres, nearest beyond them. Bins of under min_count values, and
    empty ones, are filled from the nearest bin first."""

    def __init__(self, bins: pd.DataFrame, variables: Sequence[str], statistic: str = "nmad", min_count: int = 100):
        self.variables = list(variables)
        rows = bins[bins["nd"] == len(self.variables)]
        mid = lambda v: (v["left"] + v["right"]) / 2 if isinstance(v, dict) else (v[0] + v[1]) / 2
        centres = np.array([[mid(r[v]) for v in self.variables] for _, r in rows.iterrows()], float)
        values = rows[statistic].to_numpy(float)
        good = np.isfinite(values) & (rows["count"].to_numpy() >= min_count)
        if not good.any():
            raise ValueError("no bin has enough values")
        self.axes = [np.unique(centres[:, k]) for k in range(len(self.variables))]
        self.grid = np.empty([len(a) for a in self.axes])
        scale = np.array([max(np.ptp(a), 1e-12) for a in self.axes])
        for where in np.ndindex(self.grid.shape):
            point = np.array([a[i] for a, i in zip(self.axes, where, strict=True)])
            distance = (((centres[good] - point) / scale) ** 2).sum(axis=1)
            self.grid[where] = values[good][int(distance.argmin())]

    def __call__(self, *xs: np.ndarray) -> np.ndarray:
        low, part = [], []
        for a, x in zip(self.axes, xs, strict=True):
            x = np.clip(np.asarray(x, float), a[0], a[-1])
            i = np.clip(np.searchsorted(a, x, "right") - 1, 0, max(0, len(a) - 2))
            low.append(i)
            part.append((x - a[i]) / (a[i + 1] - a[i]) if len(a) > 1 else np.zeros_like(x))
        out = 0.0
        for corner in itertools.product((0, 1), repeat=len(self.axes)):
            weight = np.prod([p if c else 1 - p for p, c in zip(part, corner, strict=True)], axis=0)
            index = tuple(np.minimum(i + c, len(a) - 1) for i, c, a in zip(low, corner, self.axes, strict=True))
            out = out + weight * self.grid[index]
        return out

    def column(self) -> Column:
        """The same as a column of the variables."""
        if len(self.axes) == 1:
            return linear_column(F.col(self.variables[0]), self.axes[0], self.grid)
        me = self

        @F.pandas_udf(T.DoubleType())
        def evaluate(xs: pd.DataFrame) -> pd.Series:
            return pd.Series(me(*(xs[c].to_numpy() for c in xs.columns)))

        return evaluate(F.struct(*(F.col(v).cast("double") for v in self.variables)))


def two_step_standardization(df: DataFrame, value: str, error: Column, fac_spread_outliers: float | None = 7.0) -> tuple[DataFrame, float]:
    """df with z (the value over its error, outliers beyond so many NMAD left out, rescaled to an NMAD of 1), and the factor
    by which errors are to be multiplied."""
    scored = df.withColumn("z", F.col(value) / error)
    first = nmad(scored, "z").first()
    if fac_spread_outliers is not None:
        scored = scored.withColumn("z", F.when(F.abs("z") <= fac_spread_outliers * first["nmad"], F.col("z")))
    factor = float(nmad(scored, "z").first()["nmad"])
    return scored.withColumn("z", F.col("z") / factor), factor


def heteroscedasticity(df: DataFrame, value: str, edges: dict[str, Sequence[float]], min_count: int = 100, fac_spread_outliers: float = 7.0, stable: Column | None = None) -> tuple[DataFrame, pd.DataFrame, BinInterpolator]:
    """df with sigma, an error for each row from how the spread of a value on stable ground depends on variables; the bin
    table; and the function of the variables (whose grid is scaled already)."""
    ground = df.where(stable) if stable is not None else df
    bins = nd_binning(ground, value, edges).toPandas()
    f = BinInterpolator(bins, list(edges), "nmad", min_count)
    _, factor = two_step_standardization(ground, value, f.column(), fac_spread_outliers)
    f.grid = f.grid * factor
    return df.withColumn("sigma", f.column()), bins, f


def histogram(df: DataFrame, column: str, n: int = 300) -> DataFrame:
    """bin (0-based), left, right and count of n bins from the minimum to the maximum; empty bins are absent."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x, lo, hi = F.col(column), F.col("_lo"), F.col("_hi")
    index = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.lit(n - 1), F.floor((x - lo) / (hi - lo) * n).cast("int")))
    binned = df.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(index.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / n
    return binned.select("bin", (F.col("_lo") + F.col("bin") * width).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("right"), "count")


def profiles(df: DataFrame, axis: str = "row", column: str = "z") -> DataFrame:
    """axis and the mean along it, NULL where fewer than half of its cells are valid."""
    g = df.groupBy(axis).agg(F.avg(column).alias("mean"), F.count(column).alias("valid"), F.count("*").alias("cells"))
    return g.select(axis, F.when(F.col("valid") * 2 >= F.col("cells"), F.col("mean")).alias("mean"), "valid")
