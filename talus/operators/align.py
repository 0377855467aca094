"""Coregistration: estimators that find how a surface is to be moved onto a reference.

Both surfaces are rasters on one grid (use reproject() first), or the surface to be aligned is a table of points. ``fit``
returns a model whose matrix moves the surface; ``apply`` moves rasters or points. Every iteration is one aggregate over a
bounded, hash-chosen sample of the reference (``subsample``, as the methods prescribe); the other surface is met through
equi-joins on cells. What reaches the driver is a few sums, or 72 bins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.numeric import nelder_mead
from talus.grid import KEY, Grid
from talus.operators import resample
from talus.operators.fitting import gram
from talus.operators.masks import include, sample
from talus.operators.stats import NFACT, nmad, quantiles

#: Points in a sample of coherent point drift at most.
MOST = 20_000


def gradients(df: DataFrame) -> DataFrame:
    """row, col, z, gx (eastward) and gn (northward) by cell: central differences, one-sided at gaps and edges."""
    along, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")

    def slope(key: str, w):
        before = F.when(F.lag(key).over(w) == F.col(key) - 1, F.lag("z").over(w))
        after = F.when(F.lead(key).over(w) == F.col(key) + 1, F.lead("z").over(w))
        return F.coalesce((after - before) / 2, after - F.col("z"), F.col("z") - before)

    return df.select("row", "col", "z").withColumn("gx", slope("col", along)).withColumn("gn", -slope("row", down))


def prepare(ref: DataFrame, inlier: DataFrame | None, subsample: float, seed: int) -> DataFrame:
    """The sample of the reference: valid cells of the mask, chosen by hash, with gradients and an id."""
    cells = gradients(ref).where("z is not null")
    cells = include(cells, inlier) if inlier is not None else cells
    cells = sample(cells, subsample, seed)
    return cells.withColumn("pid", F.struct("row", "col"))


def _dh(sampled: DataFrame, tba: DataFrame, east: float, north: float) -> DataFrame:
    """sampled with dh: reference less the surface moved by cells east and north."""
    placed = sampled.withColumns({"prow": F.col("row") + north, "pcol": F.col("col") - east})
    return resample.interp(placed, tba, {"zt": "z"}).withColumn("dh", F.col("z") - F.col("zt")).where("dh is not null")


def located(points: DataFrame, grid: Grid, inlier: DataFrame | None, subsample: float, seed: int) -> DataFrame:
    """A sample of points (pid, x, y, z) chosen by hash, with their place on the grid (row0, col0); with a mask of cells only
    those whose nearest cell it holds."""
    row, col = grid.place(F.col("x"), F.col("y"))
    rows = points.where("x is not null and y is not null and z is not null").select("pid", "x", "y", "z", row.alias("row0"), col.alias("col0"))
    if inlier is not None:
        rows = include(rows.withColumns({"row": F.floor(F.col("row0") + 0.5).cast("int"), "col": F.floor(F.col("col0") + 0.5).cast("int")}), inlier).drop("row", "col")
    return sample(rows, subsample, seed, ["pid"])


def _dh_points(sampled: DataFrame, raster: DataFrame, east: float, north: float) -> DataFrame:
    """sampled points moved by cells east and north, with dh (raster less point) and the raster's gradients there."""
    placed = sampled.withColumns({"prow": F.col("row0") - north, "pcol": F.col("col0") + east})
    met = resample.interp(placed, raster, {"zt": "z", "gx": "gx", "gn": "gn"})
    return met.withColumn("dh", F.col("zt") - F.col("z")).where("dh is not null")


@dataclass
class Fit:
    """A fitted model: the matrix, the point it turns about, and what the method reports."""

    matrix: np.ndarray
    centroid: tuple[float, float, float] = (0.0, 0.0, 0.0)
    report: dict = field(default_factory=dict)

    def apply(self, df: DataFrame, grid: Grid, resample_to_grid: bool = True) -> tuple[DataFrame, Grid]:
        return resample.apply_to_raster(df, grid, self.matrix, self.centroid, resample=resample_to_grid)

    def apply_points(self, points: DataFrame, z: str = "z") -> DataFrame:
        return resample.apply_to_points(points, self.matrix, self.centroid, z=z)

    @property
    def translations(self) -> tuple[float, float, float]:
        return resample.decompose(self.matrix)[:3]

    @property
    def rotations(self) -> tuple[float, float, float]:
        return resample.decompose(self.matrix)[3:]

    def inverse(self) -> Fit:
        """The fit that moves the other way."""
        return Fit(resample.invert(self.matrix), self.centroid, self.report)

    @property
    def is_translation(self) -> bool:
        return bool(np.allclose(np.asarray(self.matrix)[:3, :3], np.eye(3)))


class Method:
    """A step of an alignment. Steps add up to pipelines with ``+``."""

    subsample: float = 5e5
    seed: int = 42

    def fit(self, ref: DataFrame, tba: DataFrame, grid: Grid, inlier: DataFrame | None = None) -> Fit:
        raise NotImplementedError(f"{type(self).__name__} has no fit")

    #: Whether the fit is a matrix, and whether it is without rotation where the method is left at its defaults.
    is_affine: ClassVar[bool] = True
    is_translation: ClassVar[bool | None] = None

    def fit_points(self, raster: DataFrame, points: DataFrame, grid: Grid, inlier: DataFrame | None = None, points_are: str = "tba") -> Fit:
        """A fit between a raster and points (pid, x, y, z): it moves the points onto the raster, or with ``points_are="ref"``
        the raster onto the points."""
        if points_are not in ("tba", "ref"):
            raise ValueError("points are tba or ref")
        fitted = self._fit_points(raster, points, grid, inlier)
        return fitted if points_are == "tba" else fitted.inverse()

    def _fit_points(self, raster, points, grid, inlier) -> Fit:
        raise NotImplementedError(f"{type(self).__name__} takes no points")

    def info(self) -> dict:
        """The method's name and settings, and what kind of transform it fits."""
        return {"method": type(self).__name__, "is_affine": self.is_affine, "is_translation": self.is_translation, "settings": dict(vars(self))}

    def fit_and_apply(self, ref: DataFrame, tba: DataFrame, grid: Grid, inlier: DataFrame | None = None) -> tuple[DataFrame, Fit]:
        fitted = self.fit(ref, tba, grid, inlier)
        return fitted.apply(tba, grid)[0], fitted

    def __add__(self, other: Method) -> Pipeline:
        mine = self.steps if isinstance(self, Pipeline) else [self]
        return Pipeline([*mine, *(other.steps if isinstance(other, Pipeline) else [other])])


@dataclass
class VerticalShift(Method):
    """The median (or another quantile) of reference less surface."""

    quantile: float = 0.5
    subsample: float = 1
    is_translation: ClassVar[bool | None] = True

    def fit(self, ref, tba, grid, inlier=None) -> Fit:
        return self._shift(_dh(prepare(ref, inlier, self.subsample, self.seed), tba, 0.0, 0.0))

    def _fit_points(self, raster, points, grid, inlier) -> Fit:
        return self._shift(_dh_points(located(points, grid, inlier, self.subsample, self.seed), gradients(raster), 0.0, 0.0))

    def _shift(self, dh: DataFrame) -> Fit:
        got = quantiles(dh, [], "dh", {"shift": self.quantile}).first()
        if got is None:
            raise ValueError("the surfaces have no valid cell in common")
        return Fit(resample.matrix(tz=float(got["shift"])), report={"shift_z": float(got["shift"]), "n": got["n"]})


def cosine_fit(bins: list[tuple[float, float]]) -> tuple[float, float, float]:
    """a, b, c of a cos(b - x) + c through points: linear in cos x and sin x."""
    x, y = (np.array(v, float) for v in zip(*bins, strict=True))
    c = np.linalg.lstsq(np.column_stack([np.cos(x), np.sin(x), np.ones(len(x))]), y, rcond=None)[0]
    return float(math.hypot(c[0], c[1])), float(math.atan2(c[1], c[0])), float(c[2])


@dataclass
class NuthKaab(Method):
    """Horizontal and vertical shift from how dh over slope depends on aspect (Nuth and Kaab 2011)."""

    max_iterations: int = 10
    tolerance: float = 0.001
    bins: int = 72
    subsample: float = 5e5
    vertical: bool = True
    is_translation: ClassVar[bool | None] = True

    def fit(self, ref, tba, grid, inlier=None) -> Fit:
        sampled = self._aspects(prepare(ref, inlier, self.subsample, self.seed)).persist()
        tba = tba.select("row", "col", "z").persist()  # both are met again in every iteration
        try:
            return self._search(lambda east, north: _dh(sampled, tba, east, north), grid)
        finally:
            sampled.unpersist()
            tba.unpersist()

    def _fit_points(self, raster, points, grid, inlier) -> Fit:
        sampled = located(points, grid, inlier, self.subsample, self.seed).persist()
        raster = gradients(raster).persist()
        try:
            return self._search(lambda east, north: self._aspects(_dh_points(sampled, raster, east, north)), grid)
        finally:
            sampled.unpersist()
            raster.unpersist()

    @staticmethod
    def _aspects(df: DataFrame) -> DataFrame:
        tan = F.sqrt(F.col("gx") * F.col("gx") + F.col("gn") * F.col("gn"))
        around = F.atan2(F.col("gx"), F.col("gn"))
        return df.withColumn("tan", tan).where("tan > 1e-9").withColumn("asp", around - F.floor(around / (2 * math.pi)) * (2 * math.pi))

    def _search(self, dh_at: Callable[[float, float], DataFrame], grid: Grid) -> Fit:
        width = 2 * math.pi / self.bins
        east = north = up = 0.0
        steps = 0
        for steps in range(1, self.max_iterations + 1):
            dh = dh_at(east, north)
            up = quantiles(dh, [], "dh", {"m": 0.5}).first()
            if up is None:
                raise ValueError("no valid cell is left in common")
            up = float(up["m"])
            ratio = dh.select(((F.col("dh") - up) / F.col("tan")).alias("y"), F.least(F.lit(self.bins - 1), F.floor(F.col("asp") / width)).alias("bin"))
            medians = quantiles(ratio, ["bin"], "y", {"y": 0.5}).collect()
            if len(medians) < 3:
                raise ValueError("too few aspects hold values")
            a, b, _ = cosine_fit([((r["bin"] + 0.5) * width, r["y"]) for r in medians])
            # dh = -gradient . (true - present shift): the fitted vector points against the shift that is missing
            east, north = east - a * math.sin(b), north - a * math.cos(b)
            if steps >= 2 and a < self.tolerance:
                break
        final = quantiles(dh_at(east, north), [], "dh", {"m": 0.5}).first()
        up = float(final["m"]) if final else up
        shift = (east * grid.resolution, north * grid.resolution, up if self.vertical else 0.0)
        return Fit(resample.matrix(*shift), report={"shift_x": shift[0], "shift_y": shift[1], "shift_z": shift[2], "iterations": steps})


#: Cells of a sample up to which a search by simplex runs within one task, and how far in cells its window reaches.
WITHIN, REACH = 500_000, 2


class _Outside(Exception):
    """A search asked for a shift beyond its window."""


def _spreads(rows: pd.DataFrame, sign: float, centre: tuple[float, float]) -> Callable[[float, float], tuple[float, float]]:
    """The NMAD and the median of dh at a shift (down, right) in cells of the sample (side 0: place and height) over a raster's
    cells (side 1). Shifts lie within REACH of the centre; each of the raster's values is looked up once."""
    own, cells = rows[rows["side"] == 0], rows[rows["side"] == 1]
    a, b, z = (own[c].to_numpy(float) for c in "abz")
    r0, c0 = np.floor(a + centre[0]).astype(np.int64), np.floor(b + centre[1]).astype(np.int64)
    # rows of the key are set apart by more than the columns and the window take
    low = int(min(c0.min(), cells["b"].min() if len(cells) else 0)) - REACH - 1
    wide = int(max(c0.max(), cells["b"].max() if len(cells) else 0)) + REACH + 2 - low
    keys = cells["a"].to_numpy(np.int64) * wide + cells["b"].to_numpy(np.int64) - low
    order = np.argsort(keys)
    keys, values = keys[order], np.append(cells["z"].to_numpy(float)[order], np.nan)
    known: dict[tuple[int, int], np.ndarray] = {}

    def moved(i: int, j: int) -> np.ndarray:
        """The raster's values by sampled cell, so many rows and columns from its cell at the centre."""
        if (i, j) not in known:
            want = (r0 + i) * wide + c0 + j - low
            at = np.searchsorted(keys, want)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == want[hit]
            known[i, j] = values[np.where(hit, at, len(keys))]
        return known[i, j]

    def spread(down: float, right: float) -> tuple[float, float]:
        if max(abs(down - centre[0]), abs(right - centre[1])) > REACH:
            raise _Outside
        r, c = np.floor(a + down), np.floor(b + right)
        fr, fc = a + down - r, b + right - c
        zt = np.zeros(len(z))
        for i, j, w in ((0, 0, (1 - fr) * (1 - fc)), (0, 1, (1 - fr) * fc), (1, 0, fr * (1 - fc)), (1, 1, fr * fc)):
            steps = (r - r0).astype(np.int64) + i, (c - c0).astype(np.int64) + j
            v = np.full(len(z), np.nan)
            for di in np.unique(steps[0]):
                for dj in np.unique(steps[1]):
                    here = (steps[0] == di) & (steps[1] == dj)
                    if (here & (w > 0)).any():
                        v[here] = moved(int(di), int(dj))[here]
            zt += np.where(w > 0, w * v, 0.0)
        dh = sign * (zt - z)
        dh = dh[~np.isnan(dh)]
        if not len(dh):
            return math.inf, math.nan
        up = float(np.median(dh))
        return float(NFACT * np.median(np.abs(dh - up))), up

    return spread


def _search_within(placed: DataFrame, raster: DataFrame, turns: tuple[int, int], sign: float, tolerance: float) -> tuple[np.ndarray, float, float]:
    """The shift (east, north) in cells with the least NMAD of dh, that NMAD and the median there. placed has places a (row), b
    (column) and heights z of a sample of at most WITHIN rows; ``turns`` says how north and east move them.

    The search runs in one task over the sample and the raster's cells around it (at most (2 REACH + 2)^2 of them a row). A
    search that leaves its window begins anew with another around the place that it asked for, and what it found before."""
    held: dict[tuple[float, float], tuple[float, float]] = {}
    at = (0.0, 0.0)
    while True:
        centre = (turns[0] * at[1], turns[1] * at[0])
        span = range(-REACH, REACH + 2)
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in span for j in span)))
        needed = placed.select("a", "b", around.alias("o")).select((F.floor(F.col("a") + centre[0]) + F.col("o.i")).cast("int").alias("row"), (F.floor(F.col("b") + centre[1]) + F.col("o.j")).cast("int").alias("col"))
        cells = raster.where("z is not null").select("row", "col", "z").join(needed, KEY, "left_semi")
        both = placed.select(F.lit(0).alias("side"), "a", "b", "z").unionByName(cells.select(F.lit(1).alias("side"), F.col("row").cast("double").alias("a"), F.col("col").cast("double").alias("b"), F.col("z").cast("double").alias("z")))
        known = dict(held)

        def run(batches: Iterator[pd.DataFrame], known: dict = known, centre: tuple = centre) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            if not parts or not sum(map(len, parts)):
                return
            spread = _spreads(pd.concat(parts, ignore_index=True), sign, centre)
            found, asked = dict(known), []

            def loss(v: np.ndarray) -> float:
                key = (float(v[0]), float(v[1]))
                if key not in found:
                    asked.append(key)
                    found[key] = spread(turns[0] * key[1], turns[1] * key[0])
                return found[key][0]

            try:
                best, _ = nelder_mead(loss, np.zeros(2), 1.0, tolerance)
                rest = [(*map(float, best), True)]
            except _Outside:
                rest = [(*asked[-1], False)]
            rows = [(*k, *v, None) for k, v in found.items() if k not in known] + [(x, y, None, None, done) for x, y, done in rest]
            yield pd.DataFrame(rows, columns=["x", "y", "loss", "up", "done"])

        got = both.repartition(1).mapInPandas(run, "x double, y double, loss double, up double, done boolean").collect()
        if not got:
            raise ValueError("the surfaces have no valid cell in common")
        held.update({(r.x, r.y): (r.loss, math.nan if r.up is None else r.up) for r in got if r.done is None})
        end = next(r for r in got if r.done is not None)
        if end.done:
            cost, up = held[end.x, end.y]
            if not math.isfinite(cost):
                raise ValueError("the surfaces have no valid cell in common")
            return np.array([end.x, end.y]), cost, up
        at = (end.x, end.y)


@dataclass
class DhMinimize(Method):
    """Horizontal shift with the least spread of dh (by default its NMAD), by a simplex search.

    With the default loss a sample of at most WITHIN cells is searched in one task, over arrays. Larger samples and other losses
    take distributed aggregates for each step of the search."""

    loss: Callable[[DataFrame], float] | None = None
    subsample: float = 5e5
    tolerance: float = 1e-3

    is_translation: ClassVar[bool | None] = True

    def fit(self, ref, tba, grid, inlier=None) -> Fit:
        sampled, tba = prepare(ref, inlier, self.subsample, self.seed).persist(), tba.select("row", "col", "z").persist()
        try:
            if self._small(sampled):
                placed = sampled.select(F.col("row").cast("double").alias("a"), F.col("col").cast("double").alias("b"), F.col("z").cast("double").alias("z"))
                return self._told(*_search_within(placed, tba, (1, -1), -1.0, self.tolerance), grid)
            return self._search(lambda east, north: _dh(sampled, tba, east, north), grid)
        finally:
            sampled.unpersist()
            tba.unpersist()

    def _fit_points(self, raster, points, grid, inlier) -> Fit:
        sampled, raster = located(points, grid, inlier, self.subsample, self.seed).persist(), gradients(raster).persist()
        try:
            if self._small(sampled):
                placed = sampled.select(F.col("row0").cast("double").alias("a"), F.col("col0").cast("double").alias("b"), F.col("z").cast("double").alias("z"))
                return self._told(*_search_within(placed, raster, (-1, 1), 1.0, self.tolerance), grid)
            return self._search(lambda east, north: _dh_points(sampled, raster, east, north), grid)
        finally:
            sampled.unpersist()
            raster.unpersist()

    def _small(self, sampled: DataFrame) -> bool:
        return self.loss is None and sampled.count() <= WITHIN

    def _search(self, dh_at: Callable[[float, float], DataFrame], grid: Grid) -> Fit:
        loss = self.loss or (lambda dh: float(nmad(dh, "dh").first()["nmad"]))

        def cost_at(v: np.ndarray) -> float:
            dh = dh_at(v[0], v[1]).persist()  # medians read it several times
            try:
                return loss(dh)
            finally:
                dh.unpersist()

        best, cost = nelder_mead(cost_at, np.zeros(2), 1.0, self.tolerance)
        up = float(quantiles(dh_at(*best), [], "dh", {"m": 0.5}).first()["m"])
        return self._told(best, cost, up, grid)

    def _told(self, best: np.ndarray, cost: float, up: float, grid: Grid) -> Fit:
        shift = (float(best[0]) * grid.resolution, float(best[1]) * grid.resolution, up)
        return Fit(resample.matrix(*shift), report={"shift_x": shift[0], "shift_y": shift[1], "shift_z": up, "loss": cost})


def _centre(sampled: DataFrame, grid: Grid) -> tuple[DataFrame, tuple[float, float, float]]:
    placed = sampled.withColumns({"x": grid.x(F.col("row"), F.col("col")), "y": grid.y(F.col("row"), F.col("col"))})
    return placed, _middle(placed)


def _middle(points: DataFrame) -> tuple[float, float, float]:
    c = points.agg(F.avg("x"), F.avg("y"), F.avg("z")).first()
    if c[0] is None:
        raise ValueError("there is no valid cell")
    return float(c[0]), float(c[1]), float(c[2])


def _rigid(p: np.ndarray, only_translation: bool) -> np.ndarray:
    return resample.matrix(*p[:3]) if only_translation else resample.matrix(*p[:3], *p[3:], degrees=False)


@dataclass
class LZD(Method):
    """Least z-differences (Rosenholm and Torlegard 1988): the reference's cells are moved and compared with the surface, and
    six parameters follow from normal equations with its gradients."""

    only_translation: bool = False
    max_iterations: int = 200
    tolerance: float = 0.01
    subsample: float = 5e5

    def fit(self, ref, tba, grid, inlier=None) -> Fit:
        placed, centre = _centre(prepare(ref, inlier, self.subsample, self.seed), grid)
        total, steps = self._solve(placed.select("pid", "x", "y", "z"), centre, tba, grid)
        return self._told(resample.invert(total), centre, steps)

    def _fit_points(self, raster, points, grid, inlier) -> Fit:
        placed = located(points, grid, inlier, self.subsample, self.seed).select("pid", "x", "y", "z")
        centre = _middle(placed)
        total, steps = self._solve(placed, centre, raster, grid)
        return self._told(total, centre, steps)

    def _told(self, m: np.ndarray, centre: tuple, steps: int) -> Fit:
        return Fit(m, centre, {"iterations": steps, "translations": resample.decompose(m)[:3], "rotations": resample.decompose(m)[3:]})

    def _solve(self, points: DataFrame, centre: tuple, surface: DataFrame, grid: Grid) -> tuple[np.ndarray, int]:
        """The matrix that moves points onto a surface, and the iterations it took."""
        g = gradients(surface).withColumns({"gx": F.col("gx") / grid.resolution, "gn": F.col("gn") / grid.resolution}).persist()
        located = points.persist()
        total, steps = np.eye(4), 0
        try:
            for steps in range(1, self.max_iterations + 1):
                moved = resample.apply_to_points(located, total, centre)
                prow, pcol = grid.place(F.col("x"), F.col("y"))
                met = resample.interp(moved.withColumns({"prow": prow, "pcol": pcol}), g, {"zt": "z", "tx": "gx", "ty": "gn"})
                met = met.where("zt is not null and tx is not null and ty is not null")
                x, y, z = (F.col(c) - o for c, o in zip(("x", "y", "z"), centre, strict=True))
                tx, ty = F.col("tx"), F.col("ty")
                terms = [-tx, -ty, F.lit(1.0)]
                if not self.only_translation:
                    terms += [y + ty * z, -x - tx * z, tx * y - ty * x]
                scale = 1.0 if self.only_translation else _spread(located)
                scaled = [t if k < 3 else t / scale for k, t in enumerate(terms)]
                a, b, n = gram(met, scaled, F.col("zt") - F.col("z"))
                if n < len(terms):
                    raise ValueError("too few valid cells are left")
                p = np.linalg.lstsq(a, b, rcond=None)[0]
                p[3:] /= scale
                step = _rigid(p, self.only_translation)
                total = resample.make_valid(step @ total)
                if np.abs(p[:3]).max() < self.tolerance * grid.resolution and (self.only_translation or np.abs(p[3:]).max() < 1e-6):
                    break
        finally:
            located.unpersist()
            g.unpersist()
        return total, steps


def _spread(located: DataFrame) -> float:
    s = located.agg(F.stddev_pop("x"), F.stddev_pop("y")).first()
    return float(max(s[0] or 0.0, s[1] or 0.0, 1e-6))


def nearest(points: DataFrame, others: DataFrame, cell: float, reach: int | None = None) -> DataFrame:
    """Each point (pid, x, y, z) with the nearest of others (oid, ox, oy, oz, ...) in three dimensions, however far, ties by oid.

    An equi-join on the 3 x 3 cells of a plane grid around a point settles all that find a partner within one cell's width,
    and the others descend a tree of boxes. With ``reach`` only others at most so many cells away in plan are asked, and a
    point without any there is left out."""
    others = others.where("ox is not null and oy is not null and oz is not null")
    boxed = _boxed(others, cell)
    if reach is not None:
        return _within(points, boxed, cell, reach)
    near = _near(points, boxed, cell)
    return near.unionByName(_descend(points.join(near.select("pid"), "pid", "left_anti"), boxed, cell))


class _Kept:
    """Others that are asked again and again: dealt by cell and kept, so that only points move; boxes are made when a point
    lies far from all of them."""

    def __init__(self, others: DataFrame, cell: float):
        self.cell = cell
        parts = max(1, int(others.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        known = others.where("ox is not null and oy is not null and oz is not null")
        self.boxed = _boxed(known, cell).repartition(parts, "bi", "bj").persist()
        self.held: list[DataFrame] = [self.boxed]
        self.last: list[DataFrame] = []

    def nearest(self, points: DataFrame) -> DataFrame:
        """As nearest(); what the call before gave is let go."""
        self._release(self.last)
        near = _near(points, self.boxed, self.cell).persist()
        self.last = [near]
        far = points.join(near.select("pid"), "pid", "left_anti").persist()
        self.last.append(far)
        if far.isEmpty():
            return near
        return near.unionByName(_descend(far, self.boxed, self.cell))

    def release(self) -> None:
        self._release(self.last)
        self._release(self.held)

    @staticmethod
    def _release(frames: list[DataFrame]) -> None:
        while frames:
            frames.pop().unpersist()


def _boxed(others: DataFrame, cell: float) -> DataFrame:
    return others.withColumns({"bi": F.floor(F.col("ox") / cell), "bj": F.floor(F.col("oy") / cell)})


def _near(points: DataFrame, boxed: DataFrame, cell: float) -> DataFrame:
    """The nearest by point where it lies within one cell's width: whatever is outside the 3 x 3 cells is farther in plan."""
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = points.select("*", around.alias("o")).withColumns({"bi": F.floor(F.col("x") / cell) + F.col("o.i"), "bj": F.floor(F.col("y") / cell) + F.col("o.j")}).drop("o")
    return _least(spread, boxed).where(F.col("d2") <= float(cell) ** 2)


#: Cells along a side of a tile within which the nearest are sought, and distances that are held at once.
TILE, AT_ONCE = 8, 2_000_000


def _within(points: DataFrame, boxed: DataFrame, cell: float, reach: int) -> DataFrame:
    """The nearest within a reach in cells: points go to their own tile once, others also to tiles within reach of them."""
    rest = [c for c in boxed.columns if c not in ("bi", "bj")]
    placed = points.select("pid", "x", "y", "z", F.floor(F.col("x") / cell).alias("bi"), F.floor(F.col("y") / cell).alias("bj"))
    one = placed.withColumns({"ti": F.floor(F.col("bi") / TILE), "tj": F.floor(F.col("bj") / TILE)})
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE)))
    two = boxed.select("*", span("bi").alias("ti")).select("*", span("bj").alias("tj"))
    fields = [*(placed.schema[c] for c in ("pid", "x", "y", "z")), *(boxed.schema[c] for c in rest)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "d2 double"])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["pid", "x", "y", "z", *rest, "d2"])
        b = b.sort_values("oid", kind="stable").reset_index(drop=True)
        by_cell = b.groupby(["bi", "bj"]).indices
        at, of, best = [], [], []
        p, o = a[["x", "y", "z"]].to_numpy(float), b[["ox", "oy", "oz"]].to_numpy(float)
        for (i, j), mine in a.groupby(["bi", "bj"]).indices.items():
            met = [by_cell[i + k, j + m] for k in range(-reach, reach + 1) for m in range(-reach, reach + 1) if (i + k, j + m) in by_cell]
            if not met:
                continue
            met = np.sort(np.concatenate(met))  # by oid, so the first of equals is the least
            step = max(1, AT_ONCE // len(met))
            for k in range(0, len(mine), step):
                part = mine[k : k + step]
                d2 = sum((p[part, None, c] - o[met, c]) ** 2 for c in range(3))
                d2[np.isnan(d2)] = np.inf
                least = d2.argmin(axis=1)
                at.append(part)
                of.append(met[least])
                best.append(d2[np.arange(len(part)), least])
        if not at:
            return pd.DataFrame(columns=["pid", "x", "y", "z", *rest, "d2"])
        out = pd.concat([a[["pid", "x", "y", "z"]].iloc[np.concatenate(at)].reset_index(drop=True), b[rest].iloc[np.concatenate(of)].reset_index(drop=True)], axis=1)
        return out.assign(d2=np.concatenate(best))

    return one.groupBy("ti", "tj").cogroup(two.groupBy("ti", "tj")).applyInPandas(run, schema)


def _least(spread: DataFrame, boxed: DataFrame) -> DataFrame:
    """Of the pairs that meet in a cell the nearest by point, with d2."""
    d2 = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2) + F.pow(F.col("z") - F.col("oz"), 2)
    rest = [c for c in boxed.columns if c not in ("bi", "bj")]
    best = spread.join(boxed, ["bi", "bj"]).withColumn("d2", d2).groupBy("pid").agg(F.min_by(F.struct("x", "y", "z", *rest, "d2"), F.struct("d2", "oid")).alias("b"))
    return best.select("pid", "b.*")


def _descend(points: DataFrame, boxed: DataFrame, cell: float) -> DataFrame:
    """The nearest of others by branch and bound: from boxes over all of them to cells, each level halves the boxes, and a
    point goes on with those that are no farther than the farthest corner of some box."""
    e = boxed.agg(F.min("bi"), F.max("bi"), F.min("bj"), F.max("bj")).first()
    if e[0] is None:
        return _least(points.withColumns({"bi": F.lit(0).cast("long"), "bj": F.lit(0).cast("long")}), boxed)
    top = max(1, e[1] - e[0], e[3] - e[2]).bit_length()
    ends = [f(c).alias(f"{n}{c}") for c in ("ox", "oy", "oz") for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
    cells = boxed.groupBy("bi", "bj").agg(*ends)
    pairs = None
    for k in range(top, -1, -1):
        up = [F.floor((F.col(c) - low) / (1 << k)).alias(c) for c, low in (("bi", e[0]), ("bj", e[2]))]
        merged = [f(f"{n}{c}").alias(f"{n}{c}") for c in ("ox", "oy", "oz") for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
        boxes = cells.select(*up, *(f"{n}{c}" for c in ("ox", "oy", "oz") for n in ("lo_", "hi_"))).groupBy("bi", "bj").agg(*merged)
        if pairs is None:
            met = points.crossJoin(F.broadcast(boxes))  # one box
        else:
            parts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
            met = pairs.select("*", parts.alias("o")).withColumns({"bi": F.col("bi") * 2 + F.col("o.i"), "bj": F.col("bj") * 2 + F.col("o.j")}).drop("o").join(boxes, ["bi", "bj"])
        least = sum((F.pow(F.greatest(F.col(f"lo_{o}") - F.col(c), F.col(c) - F.col(f"hi_{o}"), F.lit(0.0)), 2) for c, o in (("x", "ox"), ("y", "oy"), ("z", "oz"))), F.lit(0.0))
        most = sum((F.pow(F.greatest(F.col(c) - F.col(f"lo_{o}"), F.col(f"hi_{o}") - F.col(c)), 2) for c, o in (("x", "ox"), ("y", "oy"), ("z", "oz"))), F.lit(0.0))
        bounded = met.select(*points.columns, "bi", "bj", least.alias("_least"), most.alias("_most"))
        bounded = bounded.withColumn("_bound", F.min("_most").over(Window.partitionBy("pid")))
        pairs = bounded.where("_least <= _bound").select(*points.columns, "bi", "bj")
    return _least(pairs.withColumns({"bi": F.col("bi") + e[0], "bj": F.col("bj") + e[2]}), boxed)


@dataclass
class ICP(Method):
    """Iterative closest points: each moved point is paired with the nearest of the reference, and a rigid step follows from
    distances to its tangent plane or to the point itself. ``picky`` keeps one point, the nearest, for each of the reference."""

    method: str = "point-to-plane"
    picky: bool = True
    only_translation: bool = False
    max_iterations: int = 20
    tolerance: float = 0.01
    subsample: float = 5e5

    def fit(self, ref, tba, grid, inlier=None) -> Fit:
        placed, centre = _centre(sample(tba.where("z is not null"), self.subsample, self.seed), grid)
        # heights are brought together first, so that pairs lie close in plan
        first = VerticalShift(subsample=self.subsample).fit(ref, tba, grid, inlier).report["shift_z"]
        return self._meet(self._cells(ref, grid, inlier), placed.select(F.struct("row", "col").alias("pid"), "x", "y", "z"), centre, grid.resolution, first)

    def _fit_points(self, raster, points, grid, inlier) -> Fit:
        placed = located(points, grid, inlier, self.subsample, self.seed).select("pid", "x", "y", "z")
        first = VerticalShift(subsample=self.subsample).fit_points(raster, points, grid, inlier).report["shift_z"]
        return self._meet(self._cells(raster, grid, inlier), placed, _middle(placed), grid.resolution, first)

    def fit_point_point(self, ref: DataFrame, tba: DataFrame, cell: float) -> Fit:
        """A fit between two sets of points (pid, x, y, z); cell is about the distance between neighbours. Points have no
        normals, so the method must be point-to-point."""
        if self.method != "point-to-point":
            raise ValueError("points without a surface are met point-to-point")
        known = "x is not null and y is not null and z is not null"
        none = F.lit(0.0)
        others = ref.where(known).select(F.col("pid").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), none.alias("nx"), none.alias("ny"), none.alias("nz"))
        placed = sample(tba.where(known).select("pid", "x", "y", "z"), self.subsample, self.seed, ["pid"])
        return self._meet(others, placed, _middle(placed), cell, 0.0)

    def _cells(self, ref: DataFrame, grid: Grid, inlier: DataFrame | None) -> DataFrame:
        """The reference's cells as points with normals."""
        g = gradients(ref).where("z is not null")
        g = include(g, inlier) if inlier is not None else g
        r = grid.resolution
        up = F.sqrt(1 + F.pow(F.col("gx") / r, 2) + F.pow(F.col("gn") / r, 2))
        return g.select(
            F.struct("row", "col").alias("oid"), grid.x(F.col("row"), F.col("col")).alias("ox"), grid.y(F.col("row"), F.col("col")).alias("oy"), F.col("z").alias("oz"),
            (-F.col("gx") / r / up).alias("nx"), (-F.col("gn") / r / up).alias("ny"), (1 / up).alias("nz"),
        )

    def _meet(self, others: DataFrame, located: DataFrame, centre: tuple, r: float, first: float) -> Fit:
        """Iterations that move points onto others; r is the width of a cell, first a vertical shift to begin with."""
        kept, located = _Kept(others, r), located.persist()
        total, steps = np.eye(4), 0
        total[2, 3] = first
        try:
            for steps in range(1, self.max_iterations + 1):
                moved = resample.apply_to_points(located, total, centre)
                pairs = kept.nearest(moved)
                if self.picky:
                    pairs = pairs.groupBy("oid").agg(F.min_by(F.struct(*(c for c in pairs.columns if c != "oid")), "d2").alias("p")).select("oid", "p.*")
                p = self._step(pairs, centre, _spread(located))
                total = resample.make_valid(_rigid(p, self.only_translation) @ total)
                if np.linalg.norm(p[:3]) < self.tolerance * r:
                    break
        finally:
            located.unpersist()
            kept.release()
        return Fit(total, centre, {"iterations": steps, "translations": resample.decompose(total)[:3], "rotations": resample.decompose(total)[3:]})

    def _step(self, pairs: DataFrame, centre: tuple, scale: float) -> np.ndarray:
        x, y, z = ((F.col(c) - o) for c, o in zip(("x", "y", "z"), centre, strict=True))
        gap = [F.col(o) - F.col(c) for c, o in (("x", "ox"), ("y", "oy"), ("z", "oz"))]
        zero = F.lit(0.0)
        axes = [(F.lit(1.0), zero, zero), (zero, F.lit(1.0), zero), (zero, zero, F.lit(1.0))]
        normals = [(F.col("nx"), F.col("ny"), F.col("nz"))] if self.method == "point-to-plane" else axes
        size = 3 if self.only_translation else 6
        a, b = np.zeros((size, size)), np.zeros(size)
        for nx, ny, nz in normals:
            turn = [(y * nz - z * ny) / scale, (z * nx - x * nz) / scale, (x * ny - y * nx) / scale]
            terms = [nx, ny, nz, *turn][:size]
            g, h, n = gram(pairs.where("nx is not null"), terms, gap[0] * nx + gap[1] * ny + gap[2] * nz)
            a, b = a + g, b + h
        if n < size:
            raise ValueError("too few pairs are left")
        p = np.linalg.lstsq(a, b, rcond=None)[0]
        p[3:] /= scale
        return p


@dataclass
class CPD(Method):
    """Coherent point drift: soft pairs between two point sets, a rigid step and a variance from their moments. The method is
    quadratic in its sample (5 000 points by default; above MOST it raises), so it runs on the driver in blocks of arrays."""

    weight: float = 0.0
    only_translation: bool = False
    max_iterations: int = 100
    tolerance: float = 0.01
    subsample: float = 5000
    block: int = 500

    def fit(self, ref, tba, grid, inlier=None) -> Fit:
        ref = include(ref, inlier) if inlier is not None else ref
        return self._drift(*(self._points(resample.to_points(df, grid, self.subsample, self.seed)) for df in (ref, tba)), grid.resolution)

    def _fit_points(self, raster, points, grid, inlier) -> Fit:
        cells = include(raster, inlier) if inlier is not None else raster
        placed = located(points, grid, inlier, self.subsample, self.seed)
        return self._drift(self._points(resample.to_points(cells, grid, self.subsample, self.seed)), self._points(placed), grid.resolution)

    def fit_point_point(self, ref: DataFrame, tba: DataFrame, cell: float) -> Fit:
        """A fit between two sets of points (pid, x, y, z); the tolerance is in units of cell."""
        known = "x is not null and y is not null and z is not null"
        return self._drift(*(self._points(sample(p.where(known), self.subsample, self.seed, ["pid"])) for p in (ref, tba)), cell)

    def _drift(self, a: np.ndarray, b: np.ndarray, cell: float) -> Fit:
        if len(a) < 3 or len(b) < 3:
            raise ValueError("too few valid cells")
        middle = np.median(a, axis=0)
        scale = np.mean([1.4826 * np.median(np.abs(v - np.median(v))) or 1.0 for v in a.T])
        x, y = (a - middle) / scale, (b - middle) / scale
        sigma2 = float(((x**2).sum(axis=1).mean() + (y**2).sum(axis=1).mean() - 2 * x.mean(axis=0) @ y.mean(axis=0)) / 3)
        rotation, shift, steps = np.eye(3), np.zeros(3), 0
        for steps in range(1, self.max_iterations + 1):
            moved = y @ rotation.T + shift
            px, p1, total, pt = self._expect(x, moved, sigma2, len(x), len(y))
            mu_x, mu_y = px.sum(axis=0) / total, p1 @ y / total
            new = np.eye(3)
            if not self.only_translation:
                u, _, v = np.linalg.svd((px - p1[:, None] * mu_x).T @ (y - mu_y))
                new = u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v
            new_shift = mu_x - new @ mu_y
            moved = y @ new.T + new_shift
            sigma2 = max(1e-10, float((pt @ (x**2).sum(axis=1) - 2 * (px * moved).sum() + p1 @ (moved**2).sum(axis=1)) / (3 * total)))
            done = np.linalg.norm(new_shift - shift) * scale < self.tolerance * cell and steps > 5
            rotation, shift = new, new_shift
            if done:
                break
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = rotation, shift * scale
        return Fit(m, tuple(map(float, middle)), {"iterations": steps, "sigma2": sigma2})

    def _points(self, df: DataFrame) -> np.ndarray:
        if self.subsample > MOST:
            raise ValueError(f"the method is quadratic in its sample and takes at most {MOST} points")
        pts = df.orderBy("pid").limit(MOST + 1).collect()
        if len(pts) > MOST:
            raise ValueError(f"the method is quadratic in its sample and takes at most {MOST} points: ask for a smaller subsample")
        return np.array([(r.x, r.y, r.z) for r in pts], float).reshape(-1, 3)

    def _expect(self, x, moved, sigma2, n, m):
        px, p1, pt = np.zeros_like(moved), np.zeros(m), np.zeros(n)
        noise = (2 * np.pi * sigma2) ** 1.5 * self.weight / max(1e-12, 1 - self.weight) * m / n
        for k in range(0, n, self.block):
            part = x[k : k + self.block]
            d = ((part[:, None, :] - moved[None, :, :]) ** 2).sum(axis=2)
            p = np.exp(-(d - (d.min(axis=1, keepdims=True) if not self.weight else 0)) / (2 * sigma2))
            p /= p.sum(axis=1, keepdims=True) + noise + 1e-300
            px += p.T @ part
            p1 += p.sum(axis=0)
            pt[k : k + self.block] = p.sum(axis=1)
        return px, p1, float(p1.sum()), pt


@dataclass
class Given(Method):
    """A transform that is known."""

    matrix: np.ndarray

    def fit(self, ref, tba, grid, inlier=None) -> Fit:
        resample.check(self.matrix)
        return Fit(np.asarray(self.matrix, float))


@dataclass
class Pipeline(Method):
    """Steps one after another, each fitted to what those before it have moved. Steps may be alignments or bias corrections
    (which have fit() and apply() too)."""

    steps: list

    def fit(self, ref, tba, grid, inlier=None) -> PipelineFit:
        fits, now = [], tba
        for step in self.steps:
            fitted = step.fit(ref, now, grid, inlier)
            fits.append(fitted)
            if step is not self.steps[-1]:
                now = fitted.apply(now, grid)[0]
        return PipelineFit(fits)


    def fit_points(self, raster, points, grid, inlier=None, points_are="tba") -> PipelineFit:
        """The steps fitted to points one after another; they move the points onto the raster."""
        if points_are != "tba":
            raise NotImplementedError("a pipeline moves points onto a raster, not a raster onto points")
        fits, now = [], points
        for step in self.steps:
            fits.append(step.fit_points(raster, now, grid, inlier))
            now = fits[-1].apply_points(now)
        return PipelineFit(fits)


@dataclass
class PipelineFit:
    fits: list

    def apply_points(self, points: DataFrame, z: str = "z") -> DataFrame:
        for f in self.fits:
            points = f.apply_points(points, z)
        return points

    def apply(self, df: DataFrame, grid: Grid) -> tuple[DataFrame, Grid]:
        for f in self.fits:
            df, grid = f.apply(df, grid)
        return df, grid

    @property
    def matrix(self) -> np.ndarray:
        """The product of the steps' matrices, if all are transforms about the origin."""
        m = np.eye(4)
        for f in self.fits:
            if not isinstance(f, Fit):
                raise ValueError("a bias correction has no matrix")
            about = np.eye(4)
            about[:3, 3] = f.centroid
            m = about @ f.matrix @ np.linalg.inv(about) @ m
        return m
