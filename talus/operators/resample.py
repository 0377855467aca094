"""Resampling and matrix operations on rasters and points.

A point needs at most four cells, so interpolation is an equi-join on cell indices: no raster is ever moved to a task as a
whole. A point between cells of which one is missing has no value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.grid import KEY, Grid


def interp(points: DataFrame, raster: DataFrame, columns: dict[str, str], prow: str = "prow", pcol: str = "pcol", method: str = "linear") -> DataFrame:
    """points (with a unique pid and fractional prow, pcol) with columns of the raster (out name -> raster column), bilinear
    or from the nearest cell; NULL where a needed cell is missing."""
    r, c = F.col(prow), F.col(pcol)
    if method == "nearest":
        corners = [(F.floor(r + 0.5), F.floor(c + 0.5), F.lit(1.0))]
    else:
        r0, c0 = F.floor(r), F.floor(c)
        fr, fc = r - r0, c - c0
        corners = [(r0, c0, (1 - fr) * (1 - fc)), (r0, c0 + 1, (1 - fr) * fc), (r0 + 1, c0, fr * (1 - fc)), (r0 + 1, c0 + 1, fr * fc)]
    around = F.array(*(F.struct(a.cast("int").alias("row"), b.cast("int").alias("col"), w.alias("w")) for a, b, w in corners))
    # each point goes once to its corners and comes back with their sums, other columns with it
    needed = points.select("*", F.explode_outer(F.filter(around, lambda k: k["w"] > 0)).alias("_k"))
    cells = raster.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *(F.col(v).alias(f"_v{k}") for k, v in enumerate(columns.values())))
    met = needed.join(cells, (F.col("_k.row") == F.col("_row")) & (F.col("_k.col") == F.col("_col")), "left")
    own = [F.first(c).alias(c) for c in points.columns if c != "pid"]
    sums = [F.when(F.count(f"_v{k}") == F.count("*"), F.sum(F.col("_k.w") * F.col(f"_v{k}"))).alias(name) for k, name in enumerate(columns)]
    return met.groupBy("pid").agg(*own, *sums)


def shift(df: DataFrame, rows: float, cols: float) -> DataFrame:
    """The raster moved by a number of rows (southward) and columns (eastward), resampled bilinearly to its own cells."""
    i, j = math.floor(rows), math.floor(cols)
    fr, fc = rows - i, cols - j
    weights = [(i, j, (1 - fr) * (1 - fc)), (i, j + 1, (1 - fr) * fc), (i + 1, j, fr * (1 - fc)), (i + 1, j + 1, fr * fc)]
    weights = [w for w in weights if w[2] > 0]
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(w).alias("w")) for a, b, w in weights)))
    spread = df.where("z is not null").select("row", "col", "z", to.alias("o"))
    moved = spread.groupBy((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("o.w")).alias("z"))
    return df.select("row", "col").join(moved.where(F.col("n") == len(weights)).drop("n"), KEY, "left")


def reproject(df: DataFrame, src: Grid, dst: Grid, cells: DataFrame, method: str = "linear") -> DataFrame:
    """The raster on the cells (row, col) of another grid in the same reference system."""
    if src.crs != dst.crs:
        raise ValueError("grids must share a reference system: projections need a library that isn't here")
    x, y = dst.x(F.col("row"), F.col("col")), dst.y(F.col("row"), F.col("col"))
    prow, pcol = src.place(x, y)
    points = cells.select(F.struct("row", "col").alias("pid"), prow.alias("prow"), pcol.alias("pcol"))
    return interp(points, df, {"z": "z"}, method=method).select("pid.row", "pid.col", "z")


def to_points(df: DataFrame, grid: Grid, n: float = 1, seed: int = 42, skip_missing: bool = True, offset: float | None = None) -> DataFrame:
    """Points (pid, x, y, z) of cells, all or a sample."""
    from talus.operators.masks import sample

    cells = sample(df.where("z is not null") if skip_missing else df, n, seed)
    return cells.select(F.struct("row", "col").alias("pid"), grid.x(F.col("row"), F.col("col"), offset).alias("x"), grid.y(F.col("row"), F.col("col"), offset).alias("y"), "z")


def from_regular_points(points: DataFrame, grid: Grid) -> DataFrame:
    """Cells from points that stand on a grid's cells."""
    row, col = grid.place(F.col("x"), F.col("y"))
    return points.select(F.round(row).cast("int").alias("row"), F.round(col).cast("int").alias("col"), "z")


def grid_points(points: DataFrame, grid: Grid, radius: float = 1.5) -> DataFrame:
    """Cells from scattered points: the mean of points within a radius (in cells), weighted by inverse squared distance.

    This stands in for linear interpolation on a triangulation; both give a plane back only approximately at its rim."""
    reach = math.ceil(radius)
    row, col = grid.place(F.col("x"), F.col("y"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))))
    p = points.select(row.alias("pr"), col.alias("pc"), "z", near.alias("o"))
    p = p.select((F.round("pr") + F.col("o.i")).cast("int").alias("row"), (F.round("pc") + F.col("o.j")).cast("int").alias("col"), "pr", "pc", "z")
    d2 = F.pow(F.col("pr") - F.col("row"), 2) + F.pow(F.col("pc") - F.col("col"), 2)
    weighted = p.withColumn("w", 1 / (d2 + 1e-6)).where(d2 <= radius * radius)
    return weighted.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))


# matrices


def matrix(tx: float = 0.0, ty: float = 0.0, tz: float = 0.0, alpha1: float = 0.0, alpha2: float = 0.0, alpha3: float = 0.0, degrees: bool = True) -> np.ndarray:
    """4 x 4 matrix of translations and rotations: about x, then y, then z."""
    a, b, c = np.radians([alpha1, alpha2, alpha3]) if degrees else (alpha1, alpha2, alpha3)
    rx = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    ry = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    rz = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    m = np.eye(4)
    m[:3, :3] = rz @ ry @ rx
    m[:3, 3] = tx, ty, tz
    return m


def decompose(m: np.ndarray, degrees: bool = True) -> tuple[float, float, float, float, float, float]:
    """Translations and rotations of a matrix."""
    check(m)
    r = m[:3, :3]
    if abs(r[2, 0]) > 1 - 1e-12:  # only the sum or difference of two angles is known
        b = -np.sign(r[2, 0]) * np.pi / 2
        a, c = np.arctan2(-np.sign(r[2, 0]) * r[0, 1], r[1, 1]), 0.0
    else:
        b = -np.arcsin(r[2, 0])
        a, c = np.arctan2(r[2, 1], r[2, 2]), np.arctan2(r[1, 0], r[0, 0])
    angles = np.degrees([a, b, c]) if degrees else np.array([a, b, c])
    return (*map(float, m[:3, 3]), *map(float, angles))


def check(m: np.ndarray, tolerance: float = 1e-6) -> None:
    """Raise unless m is a rigid 4 x 4 transform."""
    m = np.asarray(m, float)
    if m.shape != (4, 4) or not np.isfinite(m).all() or not np.allclose(m[3], [0, 0, 0, 1], atol=tolerance):
        raise ValueError("a transform is a finite 4 x 4 matrix that ends in 0 0 0 1")
    r = m[:3, :3]
    if not np.allclose(r @ r.T, np.eye(3), atol=tolerance) or np.linalg.det(r) < 0:
        raise ValueError("its upper left 3 x 3 part must be a rotation")


def make_valid(m: np.ndarray) -> np.ndarray:
    """m with the nearest rotation."""
    u, _, v = np.linalg.svd(m[:3, :3])
    out = np.array(m, float)
    out[:3, :3] = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v
    out[3] = 0, 0, 0, 1
    return out


def invert(m: np.ndarray) -> np.ndarray:
    """The inverse of a rigid transform."""
    check(m)
    out = np.eye(4)
    out[:3, :3] = m[:3, :3].T
    out[:3, 3] = -m[:3, :3].T @ m[:3, 3]
    return out


def apply_to_points(points: DataFrame, m: np.ndarray, centroid: tuple[float, float, float] = (0.0, 0.0, 0.0), inverse: bool = False, z: str = "z") -> DataFrame:
    """points with x, y and z transformed about a centroid; other columns stay."""
    m = invert(m) if inverse else m
    d = [F.col(c) - F.lit(float(o)) for c, o in zip(("x", "y", z), centroid, strict=True)]
    new = [sum((F.lit(float(m[i, k])) * d[k] for k in range(3)), F.lit(float(m[i, 3] + centroid[i]))) for i in range(3)]
    return points.withColumns({"x": new[0], "y": new[1], z: new[2]})


def apply_to_raster(df: DataFrame, grid: Grid, m: np.ndarray, centroid: tuple[float, float, float] = (0.0, 0.0, 0.0), inverse: bool = False, resample: bool = True, iterations: int = 6) -> tuple[DataFrame, Grid]:
    """The raster moved by a matrix. A vertical shift is added; a translation moves the grid, and resamples to the old one if
    asked; rotations are undone cell by cell: for each target cell the place that lands on it is found by fixed-point steps,
    each an interpolation of the raster, which settles for rotations of some degrees."""
    m = invert(m) if inverse else np.asarray(m, float)
    check(m)
    if np.allclose(m[:3, :3], np.eye(3), atol=1e-12):
        lifted = df.withColumn("z", F.col("z") + float(m[2, 3]))
        if not m[0, 3] and not m[1, 3]:
            return lifted, grid
        if not resample:
            return lifted, grid.moved(float(m[0, 3]), float(m[1, 3]))
        a, _, _, _, e, _ = grid.transform
        return shift(lifted, float(m[1, 3]) / e, float(m[0, 3]) / a), grid
    back, (cx, cy, cz) = invert(m), tuple(map(float, centroid))
    tiled = _rotated_tiles(df, grid, m, back, (cx, cy, cz), iterations)
    if tiled is not None:
        return tiled, grid
    cells = df.select(F.struct("row", "col").alias("pid"), F.col("z").alias("h"), grid.x(F.col("row"), F.col("col")).alias("X"), grid.y(F.col("row"), F.col("col")).alias("Y"))
    now = cells.withColumn("h", F.coalesce("h", F.lit(cz)))
    for _ in range(iterations):
        # the source of (X, Y, h), then the height that this source gets when it is moved
        s = [F.lit(float(back[i, 3])) + F.lit(float(back[i, 0])) * (F.col("X") - cx) + F.lit(float(back[i, 1])) * (F.col("Y") - cy) + F.lit(float(back[i, 2])) * (F.col("h") - cz) for i in range(2)]
        prow, pcol = grid.place(s[0] + cx, s[1] + cy)
        placed = now.select("pid", "X", "Y", (s[0]).alias("sx"), (s[1]).alias("sy"), prow.alias("prow"), pcol.alias("pcol"))
        found = interp(placed, df, {"sz": "z"})
        height = F.lit(float(m[2, 0])) * F.col("sx") + F.lit(float(m[2, 1])) * F.col("sy") + F.lit(float(m[2, 2])) * (F.col("sz") - cz) + float(m[2, 3]) + cz
        now = found.select("pid", "X", "Y", height.alias("h"))
    return now.select("pid.row", "pid.col", F.col("h").alias("z")), grid


#: Cells along a side of a tile of a rotated raster, and how far in cells heights may move a cell's target for tiles to be taken.
TILE, DRIFT = 256, 32


def _rotated_tiles(df: DataFrame, grid: Grid, m: np.ndarray, back: np.ndarray, centroid: tuple, iterations: int) -> DataFrame | None:
    """The steps of a rotation within tiles, or None where heights move cells too far for them.

    Each cell goes to its own tile as a target, and to all tiles that hold a target which may ask for it: where a cell of its
    place lands with the least and the greatest height, and three cells around. So the raster is dealt once for all steps."""
    cx, cy, cz = centroid
    e = df.agg(F.min("z"), F.max("z")).first()
    low, high = (cz, cz) if e[0] is None else (min(float(e[0]), cz), max(float(e[1]), cz))
    # heights that a step gives are those of the raster, moved; they are bounded by how far a cell of the raster can rise
    ends = df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if ends[0] is None:
        return None
    a, b, c0, d, f, g0 = grid.transform
    o, det = grid._offset(), a * f - b * d

    def plane(r, c):
        """x and y of numbers or arrays, less the centroid."""
        return a * (c + o) + b * (r + o) + c0 - cx, d * (c + o) + f * (r + o) + g0 - cy

    def place(x, y):
        return a / det * (y + cy - g0) - d / det * (x + cx - c0) - o, f / det * (x + cx - c0) - b / det * (y + cy - g0) - o

    corners = [plane(float(r), float(c)) for r in ends[:2] for c in ends[2:]]
    rise = [m[2, 0] * x + m[2, 1] * y + m[2, 2] * (h - cz) + m[2, 3] + cz for x, y in corners for h in (low, high)]
    # sources may lie a little outside the raster, where they find no height
    least, most = min(low, *rise), max(high, *rise)
    drift = (most - least) * math.hypot(back[0, 2], back[1, 2]) / math.sqrt(abs(det))
    if not math.isfinite(drift) or drift > DRIFT:
        return None
    flat = np.linalg.inv(back[:2, :2])
    x, y = grid.x(F.col("row").cast("double"), F.col("col").cast("double")) - cx, grid.y(F.col("row").cast("double"), F.col("col").cast("double")) - cy
    lands = []
    for h in (least, most):
        dx, dy = x - float(back[0, 3] + back[0, 2] * (h - cz)), y - float(back[1, 3] + back[1, 2] * (h - cz))
        lands.append(grid.place(float(flat[0, 0]) * dx + float(flat[0, 1]) * dy + cx, float(flat[1, 0]) * dx + float(flat[1, 1]) * dy + cy))
    span = lambda k: F.explode(F.sequence(F.floor((F.least(lands[0][k], lands[1][k]) - 3) / TILE), F.floor((F.greatest(lands[0][k], lands[1][k]) + 3) / TILE)))
    sources = df.where("z is not null").select("row", "col", "z", span(0).alias("ti"), F.lit(1).alias("side")).select("*", span(1).alias("tj")).select("ti", "tj", "side", "row", "col", "z")
    targets = df.select(F.floor(F.col("row") / TILE).alias("ti"), F.floor(F.col("col") / TILE).alias("tj"), F.lit(0).alias("side"), "row", "col", "z")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        row, col, z = rows["row"].to_numpy(np.int64), rows["col"].to_numpy(np.int64), rows["z"].to_numpy(float)
        own, src = side == 0, side == 1
        r, c, h = row[own], col[own], z[own]
        if not src.any() or not own.any():
            return pd.DataFrame({"row": r, "col": c, "z": np.full(len(r), np.nan)})
        r0, k0 = row[src].min(), col[src].min()
        held = np.full((row[src].max() - r0 + 1, col[src].max() - k0 + 1), np.nan)
        held[row[src] - r0, col[src] - k0] = z[src]

        def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            inside = (i >= r0) & (i < r0 + held.shape[0]) & (j >= k0) & (j < k0 + held.shape[1])
            out = np.full(len(i), np.nan)
            out[inside] = held[i[inside] - r0, j[inside] - k0]
            return out

        gx, gy = plane(r.astype(float), c.astype(float))
        h = np.where(np.isnan(h), cz, h)
        for _ in range(iterations):
            sx, sy = (back[i, 3] + back[i, 0] * gx + back[i, 1] * gy + back[i, 2] * (h - cz) for i in range(2))
            pr, pc = place(sx, sy)
            known = np.isfinite(pr) & np.isfinite(pc)
            fr, fc = np.floor(np.where(known, pr, 0)), np.floor(np.where(known, pc, 0))
            i, j, u, v = fr.astype(np.int64), fc.astype(np.int64), pr - fr, pc - fc
            sz = np.zeros(len(r))
            for di, dj, w in ((0, 0, (1 - u) * (1 - v)), (0, 1, (1 - u) * v), (1, 0, u * (1 - v)), (1, 1, u * v)):
                sz += np.where(w > 0, w * at(i + di, j + dj), 0.0)
            sz[~known] = np.nan
            h = m[2, 0] * sx + m[2, 1] * sy + m[2, 2] * (sz - cz) + m[2, 3] + cz
        return pd.DataFrame({"row": r, "col": c, "z": h})

    out = targets.unionByName(sources).groupBy("ti", "tj").applyInPandas(run, "row int, col int, z double")
    return out.withColumn("z", F.when(~F.isnan("z"), F.col("z")))
