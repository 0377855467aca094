"""Tiled alignment: each tile gets its own shift, and planes through the shifts bend the surface."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.numeric import ransac_plane
from talus.grid import KEY, Grid
from talus.operators.masks import include
from talus.operators.resample import grid_points

_SCHEMA = "tile_row int, tile_col int, x double, y double, shift_x double, shift_y double, shift_z double"


def tile_shift(ref: np.ndarray, tba: np.ndarray, iterations: int = 10, bins: int = 72, vertical_only: bool = False) -> tuple[float, float, float]:
    """Shift east, north (in cells) and up that moves one array onto another: medians of dh over slope by aspect, as in the
    method for whole surfaces."""
    gn, gx = (-g if k == 0 else g for k, g in enumerate(np.gradient(ref)))
    tan, asp = np.hypot(gx, gn), np.arctan2(gx, gn) % (2 * np.pi)
    rows, cols = np.indices(ref.shape).astype(float)
    east = north = 0.0
    for _ in range(0 if vertical_only else iterations):
        dh = ref - _bilinear(tba, rows + north, cols - east)
        ok = np.isfinite(dh) & np.isfinite(tan) & (tan > 1e-9)
        if ok.sum() < 30:
            raise ValueError("too few valid cells")
        y = (dh[ok] - np.median(dh[ok])) / tan[ok]
        which = np.minimum(bins - 1, (asp[ok] / (2 * np.pi) * bins).astype(int))
        order = np.argsort(which, kind="stable")
        parts = np.split(y[order], np.flatnonzero(np.diff(which[order])) + 1)
        x = (np.unique(which) + 0.5) * 2 * np.pi / bins
        c = np.linalg.lstsq(np.column_stack([np.cos(x), np.sin(x), np.ones(len(x))]), [np.median(p) for p in parts], rcond=None)[0]
        east, north = east - c[1], north - c[0]
        if np.hypot(c[0], c[1]) < 1e-3:
            break
    dh = ref - _bilinear(tba, rows + north, cols - east)
    if not np.isfinite(dh).any():
        raise ValueError("no valid cells")
    return float(east), float(north), float(np.nanmedian(dh))


def _bilinear(z: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    i, j = np.floor(r).astype(int), np.floor(c).astype(int)
    fr, fc = r - i, c - j
    out = np.zeros(r.shape)
    for di, dj, w in ((0, 0, (1 - fr) * (1 - fc)), (0, 1, (1 - fr) * fc), (1, 0, fr * (1 - fc)), (1, 1, fr * fc)):
        a, b = i + di, j + dj
        ok = (a >= 0) & (a < z.shape[0]) & (b >= 0) & (b < z.shape[1])
        v = np.full(r.shape, np.nan)
        v[ok] = z[a[ok], b[ok]]
        out += np.where(w > 1e-12, w * v, 0.0)
    return out


@dataclass
class BlockwiseFit:
    """Tile shifts, and the planes (a, b, c: a x + b y + c) of the shift in x, y and z."""

    shifts: DataFrame
    planes: dict[str, tuple[float, float, float]]

    def apply(self, df: DataFrame, grid: Grid, resample_to_grid: bool = True) -> tuple[DataFrame, Grid]:
        x, y = grid.x(F.col("row"), F.col("col")), grid.y(F.col("row"), F.col("col"))
        at = lambda p: F.lit(p[0]) * x + F.lit(p[1]) * y + F.lit(p[2])
        moved = df.where("z is not null").select(
            (x + at(self.planes["shift_x"])).alias("x"), (y + at(self.planes["shift_y"])).alias("y"), (F.col("z") + at(self.planes["shift_z"])).alias("z")
        )
        return df.select(*KEY).join(grid_points(moved, grid), KEY, "left"), grid


@dataclass
class BlockwiseCoreg:
    """Alignment by tiles. A tile is the unit of memory; tiles of which the fit fails have no shift."""

    tile: int = 500
    threshold: float = 0.01
    iterations: int = 2000
    vertical_only: bool = False

    def shifts(self, ref: DataFrame, tba: DataFrame, grid: Grid, inlier: DataFrame | None = None) -> DataFrame:
        """Tile indices, the tile's centre and its shifts in units of the grid."""
        ref = include(ref, inlier) if inlier is not None else ref
        both = tba.select(*KEY, F.col("z").alias("t")).join(ref.select(*KEY, F.col("z").alias("r")), KEY)
        tiled = both.withColumns({"tile_row": F.floor(F.col("row") / self.tile).cast("int"), "tile_col": F.floor(F.col("col") / self.tile).cast("int")})
        size, res, only = self.tile, grid.resolution, self.vertical_only
        a, _, c0, _, e, f0 = grid.transform

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            i, j = pdf["row"].to_numpy() - key[0] * size, pdf["col"].to_numpy() - key[1] * size
            ref_a, tba_a = np.full((size, size), np.nan), np.full((size, size), np.nan)
            ref_a[i, j], tba_a[i, j] = pdf["r"].to_numpy(float), pdf["t"].to_numpy(float)
            used = (slice(int(i.min()), int(i.max()) + 1), slice(int(j.min()), int(j.max()) + 1))
            try:
                east, north, up = tile_shift(ref_a[used], tba_a[used], vertical_only=only)
            except (ValueError, np.linalg.LinAlgError):
                east = north = up = None
            x, y = c0 + a * (pdf["col"].mean() + 0.5), f0 + e * (pdf["row"].mean() + 0.5)
            return pd.DataFrame([[key[0], key[1], x, y, None if east is None else east * res, None if north is None else north * res, up]], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

        return tiled.groupBy("tile_row", "tile_col").applyInPandas(run, _SCHEMA)

    def fit(self, ref, tba, grid, inlier=None) -> BlockwiseFit:
        shifts = self.shifts(ref, tba, grid, inlier)
        rows = shifts.toPandas()
        ok = rows.dropna()
        if ok.empty:
            raise ValueError("no tile could be aligned")
        planes = {k: ransac_plane(ok["x"].to_numpy(), ok["y"].to_numpy(), ok[k].to_numpy(float), self.threshold, self.iterations) for k in ("shift_x", "shift_y", "shift_z")}
        return BlockwiseFit(shifts, planes)
