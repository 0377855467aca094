"""Bias corrections: the difference to a reference as a function of variables, added to the surface.

Three ways: ``fit`` a function, ``bin`` and look medians up (or interpolate between them), or fit a function to binned
medians. Variables are columns of the reference's cells: pixel indices, a rotated coordinate, a terrain attribute, or given.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.grid import KEY, Grid
from talus.operators.align import Method
from talus.operators.fitting import fit_polynomial, fit_sines, linear_fit, polynomial_1d, sum_of_sines
from talus.operators.masks import include, sample
from talus.operators.stats import bin_index, linear_column, quantiles
from talus.operators.terrain import terrain_attributes


@dataclass
class Correction:
    """A fitted correction: a column of the variables, which are made again where it is applied."""

    column: Column
    variables: Callable[[DataFrame, Grid], DataFrame]
    report: dict = field(default_factory=dict)

    def apply(self, df: DataFrame, grid: Grid, resample_to_grid: bool = True) -> tuple[DataFrame, Grid]:
        with_vars = self.variables(df, grid)
        return with_vars.withColumn("z", F.col("z") + self.column).select("row", "col", "z"), grid


@dataclass
class BiasCorr(Method):
    """A correction along given variables: ``variables(df, grid)`` adds their columns to cells."""

    names: Sequence[str] = ()
    variables: Callable[[DataFrame, Grid], DataFrame] | None = None
    how: str = "bin"
    bins: int = 10
    interpolate: bool = True
    function: str = "polynomial"
    subsample: float = 1
    is_affine: ClassVar[bool] = False
    is_translation: ClassVar[bool | None] = False

    def differences(self, ref: DataFrame, tba: DataFrame, grid: Grid, inlier: DataFrame | None) -> DataFrame:
        both = self.with_variables(tba, grid).join(ref.select(*KEY, F.col("z").alias("_ref")), KEY)
        both = both.withColumn("dh", F.col("_ref") - F.col("z")).where("dh is not null")
        both = include(both, inlier) if inlier is not None else both
        return sample(both, self.subsample, self.seed)

    def with_variables(self, df: DataFrame, grid: Grid) -> DataFrame:
        return df if self.variables is None else self.variables(df, grid)

    def fit(self, ref, tba, grid, inlier=None) -> Correction:
        if self.how not in ("fit", "bin", "bin_and_fit"):
            raise ValueError("a correction is made by fit, bin or bin_and_fit")
        # ends and medians read the differences several times, and they may cost windows and joins
        dh = self.differences(ref, tba, grid, inlier).select("dh", *self.names).persist()
        try:
            return self._by_function(dh) if self.how == "fit" else self._by_bins(dh)
        finally:
            dh.unpersist()

    def _about(self) -> dict:
        return {"how": self.how, "variables": list(self.names)}

    def _by_function(self, dh: DataFrame) -> Correction:
        if len(self.names) != 1:
            raise ValueError("a function is fitted along one variable; use Deramp for planes and surfaces")
        x = self.names[0]
        if self.function == "polynomial":
            coefficients, order = fit_polynomial(dh, x, "dh")
            return Correction(polynomial_1d(F.col(x), coefficients), self.with_variables, self._about() | {"coefficients": coefficients, "order": order})
        medians = self._medians(dh, x)
        return self._sines(x, medians)

    def _sines(self, x: str, medians: tuple) -> Correction:
        parameters = fit_sines(*medians)
        return Correction(sum_of_sines(F.col(x), parameters), self.with_variables, self._about() | {"parameters": parameters})

    def _edges(self, dh: DataFrame, x: str) -> np.ndarray:
        ends = dh.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        if ends["lo"] is None:
            raise ValueError(f"{x} has no valid value")
        return np.linspace(ends["lo"], max(ends["hi"], ends["lo"] + 1e-9), self.bins + 1)

    def _medians(self, dh: DataFrame, x: str) -> tuple[np.ndarray, np.ndarray]:
        """Bin centres and medians; empty bins are NaN."""
        edges = self._edges(dh, x)
        rows = quantiles(dh.withColumn("_bin", bin_index(F.col(x), edges)).where("_bin is not null"), ["_bin"], "dh", {"m": 0.5}).collect()
        values = np.full(self.bins, np.nan)
        for r in rows:
            values[r["_bin"]] = r["m"]
        return (edges[1:] + edges[:-1]) / 2, values

    def _by_bins(self, dh: DataFrame) -> Correction:
        if self.how == "bin_and_fit":
            medians = self._medians(dh, self.names[0])
            if self.function == "sines":
                return self._sines(self.names[0], medians)
            good = np.isfinite(medians[1])
            c = np.polynomial.polynomial.polyfit(medians[0][good], medians[1][good], min(6, int(good.sum()) - 1))
            return Correction(polynomial_1d(F.col(self.names[0]), list(c)), self.with_variables, self._about() | {"coefficients": list(c)})
        if len(self.names) == 1:
            x = self.names[0]
            centres, values = self._medians(dh, x)
            if self.interpolate:
                column = linear_column(F.col(x), centres, values)
            else:
                step = centres[1] - centres[0] if len(centres) > 1 else 1.0
                edges = np.append(centres - step / 2, centres[-1] + step / 2)
                column = F.element_at(F.array(*(F.lit(float(v)) if np.isfinite(v) else F.lit(None).cast("double") for v in values)), bin_index(F.col(x), edges) + 1)
            return Correction(column, self.with_variables, self._about() | {"centres": centres, "values": values})
        # several variables: a step function over their joint bins
        edges = {x: self._edges(dh, x) for x in self.names}
        keys = [bin_index(F.col(x), e).alias(f"_b{k}") for k, (x, e) in enumerate(edges.items())]
        names = [f"_b{k}" for k in range(len(keys))]
        rows = quantiles(dh.select("dh", *keys).dropna(), names, "dh", {"m": 0.5}).collect()
        table = F.create_map(*(v for r in rows for v in (F.lit("_".join(str(r[n]) for n in names)), F.lit(float(r["m"])))))
        key = F.concat_ws("_", *(bin_index(F.col(x), e).cast("string") for x, e in edges.items()))
        return Correction(F.try_element_at(table, key), self.with_variables, self._about() | {"bins": len(rows)})


@dataclass
class Deramp(Method):
    """A polynomial surface in pixel indices, from normal equations over scaled indices."""

    order: int = 2
    subsample: float = 5e5
    is_affine: ClassVar[bool] = False
    is_translation: ClassVar[bool | None] = False

    def fit(self, ref, tba, grid, inlier=None) -> Correction:
        dh = BiasCorr(subsample=self.subsample).differences(ref, tba, grid, inlier)
        ends = dh.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
        if ends["r"] is None:
            raise ValueError("the surfaces have no valid cell in common")
        x, y = F.col("col") / float(max(1, ends["c"])), F.col("row") / float(max(1, ends["r"]))
        powers = [(i, j) for i in range(self.order + 1) for j in range(self.order + 1)]
        terms = [F.pow(x, F.lit(i)) * F.pow(y, F.lit(j)) for i, j in powers]
        c = linear_fit(dh, terms, F.col("dh"))
        column = sum((t * float(v) for t, v in zip(terms, c, strict=True)), F.lit(0.0))
        scaled = {p: float(v) / max(1, ends["c"]) ** p[0] / max(1, ends["r"]) ** p[1] for p, v in zip(powers, c, strict=True)}
        return Correction(column, lambda df, grid: df, {"coefficients": scaled})


def rotated(df: DataFrame, grid: Grid, angle: float) -> DataFrame:
    """df with _along, the coordinate along a direction (degrees, anticlockwise from east)."""
    a = math.radians(angle)
    x, y = grid.x(F.col("row"), F.col("col")), grid.y(F.col("row"), F.col("col"))
    return df.withColumn("_along", x * math.cos(a) + y * math.sin(a))


def DirectionalBias(angle: float = 0.0, how: str = "bin_and_fit", bins: int = 100, function: str = "sines", subsample: float = 1) -> BiasCorr:
    """A correction along a direction, by default a sum of sines through binned medians."""
    return BiasCorr(["_along"], lambda df, grid: rotated(df, grid, angle), how, bins, True, function, subsample)


def TerrainBias(attribute: str = "max_curvature", how: str = "bin", bins: int = 100, subsample: float = 1, **options) -> BiasCorr:
    """A correction along a terrain attribute of the surface itself."""

    def add(df: DataFrame, grid: Grid) -> DataFrame:
        t = terrain_attributes(df, attribute, grid.resolution, **options).withColumnRenamed(attribute, "_attribute")
        return df.join(t, KEY, "left")

    return BiasCorr(["_attribute"], add, how, bins, True, "polynomial", subsample)
