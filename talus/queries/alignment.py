"""Alignment and bias correction of a pair of surfaces.

The pair is the dense surface, smoothed so that it has slopes that hold over some cells, and the same surface moved by a known
shift; tables of sums that the methods need are checked in SQL, whole fits by what they recover.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from talus.grid import Grid
from talus.operators import align, biascorr, blockwise, resample
from talus.queries.least import fitted
from talus.queries.statistics import r6
from talus.queries.surfaces import DENSE, PAIR, POINTS
from talus.sources import tables

QUERIES, SQL = {}, {}
GRID = Grid(transform=(20.0, 0.0, 500000.0, 0.0, -20.0, 8000000.0))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def hills(spark, sf_dir: str):
    """A smooth surface on the cells of the dense one, with some of its values as noise."""
    d = tables.dense(spark, sf_dir)
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    return d.select("row", "col", (30 * F.sin(r / 9) + 25 * F.cos(c / 7) + 12 * F.sin((r + 2 * c) / 13) + F.col("z") / 200).alias("z"))


def moved_pair(spark, sf_dir: str, east: float = 0.6, north: float = -0.4, up: float = 3.0):
    """The reference, and the surface that a shift by (east, north) cells and up units puts onto it."""
    ref = hills(spark, sf_dir)
    return ref, resample.shift(ref, north, -east).withColumn("z", F.col("z") - up)


def _fit_row(spark, fit):
    t, r = fit.translations, fit.rotations
    return spark.createDataFrame([tuple(round(float(v), 4) for v in (*t, *r))], "shift_x double, shift_y double, shift_z double, rot_x double, rot_y double, rot_z double")


def pair(spark, sf_dir):
    p = tables.pair(spark, sf_dir)
    return p.select("row", "col", F.col("z_ref").alias("z")), p.select("row", "col", F.col("z_tba").alias("z"))


@query("gradients", f"WITH s AS ({DENSE}) SELECT row, col, round(CASE WHEN w IS NULL THEN e - z WHEN e IS NULL THEN z - w ELSE (e - w) / 2 END, 6) AS gx, round(-(CASE WHEN n IS NULL THEN s - z WHEN s IS NULL THEN z - n ELSE (s - n) / 2 END), 6) AS gn FROM (SELECT row, col, z, lag(z) OVER a AS w, lead(z) OVER a AS e, lag(z) OVER b AS n, lead(z) OVER b AS s FROM s WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY col ORDER BY row))")
def _(spark, sf):
    return align.gradients(tables.dense(spark, sf)).select("row", "col", *r6("gx", "gn"))


@query("vshift_median", f"WITH p AS ({PAIR}) SELECT round(median(z_ref - z_tba), 6) AS shift_z, count(*) AS n FROM p")
def _(spark, sf):
    ref, tba = pair(spark, sf)
    report = align.VerticalShift().fit(ref, tba, Grid()).report
    return spark.createDataFrame([(round(report["shift_z"], 6), report["n"])], "shift_z double, n long")


#: Points spread over the cells of the dense surface.
_ON_GRID = f"WITH s AS ({DENSE}), p AS (SELECT pid, x / 4 + 0.13 AS c, y - floor(y / 400) * 400 AS r, z / 10 AS z FROM ({POINTS})), q AS (SELECT *, floor(r) AS r0, floor(c) AS c0 FROM p)"


@query("vshift_points", _ON_GRID + ", d AS (SELECT (1 - (r - r0)) * ((1 - (c - c0)) * a.z + (c - c0) * b.z) + (r - r0) * ((1 - (c - c0)) * d.z + (c - c0) * e.z) - q.z AS dh FROM q JOIN s a ON a.row = r0 AND a.col = c0 JOIN s b ON b.row = r0 AND b.col = c0 + 1 JOIN s d ON d.row = r0 + 1 AND d.col = c0 JOIN s e ON e.row = r0 + 1 AND e.col = c0 + 1) SELECT round(median(dh), 6) AS shift_z, count(*) AS n FROM d")
def _(spark, sf):
    """The vertical shift that brings points onto a raster, and how many points meet it."""
    p = tables.points(spark, sf)
    grid = Grid(area_or_point="Point")
    spread = p.select("pid", (F.col("x") / 4 + 0.13).alias("pcol"), (F.col("y") - F.floor(F.col("y") / 400) * 400).alias("prow"), (F.col("z") / 10).alias("z"))
    points = spread.select("pid", grid.x(F.col("prow"), F.col("pcol")).alias("x"), grid.y(F.col("prow"), F.col("pcol")).alias("y"), "z")
    report = align.VerticalShift().fit_points(tables.dense(spark, sf), points, grid).report
    return spark.createDataFrame([(round(report["shift_z"], 6), report["n"])], "shift_z double, n long")


@query("nk_points")
def _(spark, sf):
    """The shift between a raster and points taken from it by interpolation, moved by a known amount."""
    ref, _tba = moved_pair(spark, sf)
    cells = ref.where("z is not null").select(F.struct("row", "col").alias("pid"), (GRID.x(F.col("row"), F.col("col")) - 0.3).alias("x"), GRID.y(F.col("row"), F.col("col")).alias("y"), (F.col("z") - 2).alias("z"))
    t = align.NuthKaab().fit_points(ref, cells, GRID).translations
    return spark.createDataFrame([tuple(round(v, 2) for v in t)], "shift_x double, shift_y double, shift_z double")


_NK = """
WITH s AS ({dense}), h AS (
  SELECT row, col, 30 * sin(row / 9.0) + 25 * cos(col / 7.0) + 12 * sin((row + 2 * col) / 13.0) + z / 200 AS z FROM s
), g AS (
  SELECT row, col, z, (CASE WHEN w IS NULL THEN e - z WHEN e IS NULL THEN z - w ELSE (e - w) / 2 END) AS gx,
         -(CASE WHEN n IS NULL THEN s - z WHEN s IS NULL THEN z - n ELSE (s - n) / 2 END) AS gn
  FROM (SELECT row, col, z, lag(z) OVER a AS w, lead(z) OVER a AS e, lag(z) OVER b AS n, lead(z) OVER b AS s FROM h
        WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY col ORDER BY row))
), t AS (
  SELECT g.*, g.z - (m.z - 3.0) AS dh FROM g JOIN h m ON m.row = g.row + 1 AND m.col = g.col
), k AS (
  SELECT (dh - (SELECT median(dh) FROM t)) / sqrt(gx * gx + gn * gn) AS y,
         atan2(gx, gn) - floor(atan2(gx, gn) / 6.283185307179586) * 6.283185307179586 AS asp FROM t WHERE sqrt(gx * gx + gn * gn) > 1e-9
)
SELECT CAST(least(71, floor(asp / 0.08726646259971647)) AS INTEGER) AS bin, count(*) AS n, round(median(y), 6) AS median FROM k GROUP BY 1
"""


@query("nk_step", _NK.format(dense=DENSE))
def _(spark, sf):
    """The medians by aspect of one step of Nuth and Kaab, with the surface one row off."""
    import math

    from talus.operators.stats import quantiles

    ref = hills(spark, sf)
    tba = ref.select((F.col("row") - 1).alias("row"), "col", (F.col("z") - 3.0).alias("z"))
    tan = F.sqrt(F.col("gx") * F.col("gx") + F.col("gn") * F.col("gn"))
    around = F.atan2(F.col("gx"), F.col("gn"))
    sampled = align.prepare(ref, None, 1, 42).withColumn("tan", tan).withColumn("asp", around - F.floor(around / (2 * math.pi)) * (2 * math.pi))
    dh = align._dh(sampled, tba, 0.0, 0.0)
    up = quantiles(dh, [], "dh", {"m": 0.5}).first()["m"]
    ratio = dh.where("tan > 1e-9").select(((F.col("dh") - up) / F.col("tan")).alias("y"), F.least(F.lit(71), F.floor(F.col("asp") / (2 * math.pi / 72))).cast("int").alias("bin"))
    return quantiles(ratio, ["bin"], "y", {"median": 0.5}).select("bin", "n", *r6("median"))


@query("nuth_kaab")
def _(spark, sf):
    return _fit_row(spark, align.NuthKaab().fit(*moved_pair(spark, sf), GRID))


@query("dh_minimize")
def _(spark, sf):
    return _fit_row(spark, align.DhMinimize().fit(*moved_pair(spark, sf), GRID))


@query("lzd")
def _(spark, sf):
    return _fit_row(spark, align.LZD().fit(*moved_pair(spark, sf), GRID))


@query("icp")
def _(spark, sf):
    return _fit_row(spark, align.ICP().fit(*moved_pair(spark, sf, 0.3, -0.2), GRID))


@query("cpd")
def _(spark, sf):
    return _fit_row(spark, align.CPD().fit(*moved_pair(spark, sf, 0.3, -0.2), GRID))


@query("pipeline_vshift_nk")
def _(spark, sf):
    ref, tba = moved_pair(spark, sf)
    steps = align.VerticalShift() + align.NuthKaab()
    aligned, _fit = steps.fit_and_apply(ref, tba, GRID)
    b = aligned.select("row", "col", F.col("z").alias("b"))
    return ref.join(b, ["row", "col"]).agg(F.count("b").alias("n"), F.round(F.stddev_pop(F.col("z") - F.col("b")), 3).alias("std"))


@query("icp_nearest", "WITH e AS (SELECT event_id AS pid, CAST(user_id AS DOUBLE) AS x, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS y, value AS z FROM events), a AS (SELECT * FROM e WHERE pid % 2 = 0), b AS (SELECT * FROM e WHERE pid % 2 = 1), d AS (SELECT a.pid, b.pid AS oid, power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) AS d2 FROM a JOIN b ON abs(floor(a.x / 20) - floor(b.x / 20)) <= 1 AND abs(floor(a.y / 20) - floor(b.y / 20)) <= 1) SELECT pid, arg_min(oid, d2) AS oid, round(min(d2), 6) AS d2 FROM d GROUP BY pid")
def _(spark, sf):
    p = tables.points(spark, sf)
    others = p.where("pid % 2 = 1").select(F.col("pid").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    return align.nearest(p.where("pid % 2 = 0"), others, 20.0, reach=1).select("pid", "oid", *r6("d2"))


_DERAMP_CELLS = f"WITH p AS ({PAIR}), d AS (SELECT row, col, z_tba, z_ref - z_tba AS dh FROM p)"


@query("lzd_gram", f"WITH p AS ({PAIR}), d AS (SELECT col / 100.0 AS x, row / 100.0 AS y, z_ref - z_tba AS dh FROM p) SELECT round(sum(x * x), 6) AS xx, round(sum(x * y), 6) AS xy, round(sum(y * y), 6) AS yy, round(sum(x * dh), 6) AS xb, round(sum(y * dh), 6) AS yb, count(*) AS n FROM d")
def _(spark, sf):
    from talus.operators.fitting import gram

    p = tables.pair(spark, sf)
    g, b, n = gram(p, [F.col("col") / 100.0, F.col("row") / 100.0], F.col("z_ref") - F.col("z_tba"))
    return spark.createDataFrame([tuple(round(float(v), 6) for v in (g[0, 0], g[0, 1], g[1, 1], b[0], b[1])) + (n,)], "xx double, xy double, yy double, xb double, yb double, n long")


@query("deramp_constant", _DERAMP_CELLS + " SELECT row, col, round(z_tba + (SELECT avg(dh) FROM d), 6) AS z FROM d")
def _(spark, sf):
    ref, tba = pair(spark, sf)
    return biascorr.Deramp(order=0, subsample=1).fit(ref, tba, Grid()).apply(tba, Grid())[0].select("row", "col", *r6("z"))


_RAMP = [f"power(x, {i}) * power(y, {j})" for i in range(3) for j in range(3)]


@query("deramp", _DERAMP_CELLS + ", e AS (SELECT *, CAST(col AS DOUBLE) / (SELECT max(col) FROM d) AS x, CAST(row AS DOUBLE) / (SELECT max(row) FROM d) AS y FROM d), " + fitted("w", "e", ["row", "col", "z_tba"], _RAMP, "dh") + " SELECT row, col, round(z_tba + f, 4) AS z FROM w")
def _(spark, sf):
    ref, tba = pair(spark, sf)
    return biascorr.Deramp(subsample=1).fit(ref, tba, Grid()).apply(tba, Grid())[0].select("row", "col", F.round("z", 4).alias("z"))


@query("bias_bins", _DERAMP_CELLS + ", e AS (SELECT min(col) AS lo, max(col) AS hi FROM d), b AS (SELECT *, CAST(least(4, floor((col - lo) / ((hi - lo) / 5.0))) AS INTEGER) AS bin FROM d, e), m AS (SELECT bin, median(dh) AS m FROM b GROUP BY bin) SELECT row, col, round(z_tba + m, 6) AS z FROM b JOIN m USING (bin)")
def _(spark, sf):
    """A step correction by column, from medians in five bins."""
    ref, tba = pair(spark, sf)
    step = biascorr.BiasCorr(["_c"], lambda df, grid: df.withColumn("_c", F.col("col").cast("double")), "bin", 5, interpolate=False)
    return step.fit(ref, tba, Grid()).apply(tba, Grid())[0].select("row", "col", *r6("z"))


_BINS_2D = """, e AS (SELECT min(col) AS c0, max(col) AS c1, min(row) AS r0, max(row) AS r1 FROM d),
b AS (SELECT row, col, z_tba, dh, least(3, floor((col - c0) / ((c1 - c0) / 4.0))) AS i, least(3, floor((row - r0) / ((r1 - r0) / 4.0))) AS j FROM d, e),
m AS (SELECT i, j, median(dh) AS m FROM b GROUP BY i, j)
SELECT row, col, round(z_tba + m, 6) AS z FROM b JOIN m USING (i, j)"""


@query("bias_bins_2d", _DERAMP_CELLS + _BINS_2D)
def _(spark, sf):
    """A step correction by column and row, from medians in their joint bins."""
    ref, tba = pair(spark, sf)
    both = lambda df, grid: df.withColumns({"_c": F.col("col").cast("double"), "_r": F.col("row").cast("double")})
    return biascorr.BiasCorr(["_c", "_r"], both, "bin", 4).fit(ref, tba, Grid()).apply(tba, Grid())[0].select("row", "col", *r6("z"))


@query("bias_polynomial")
def _(spark, sf):
    ref, tba = pair(spark, sf)
    step = biascorr.BiasCorr(["_c"], lambda df, grid: df.withColumn("_c", F.col("col").cast("double")), "bin_and_fit", 12)
    return step.fit(ref, tba, Grid()).apply(tba, Grid())[0].select("row", "col", F.round("z", 4).alias("z"))


@query("directional_bias")
def _(spark, sf):
    ref, tba = pair(spark, sf)
    return biascorr.DirectionalBias(30.0, bins=40).fit(ref, tba, Grid()).apply(tba, Grid())[0].select("row", "col", F.round("z", 4).alias("z"))


@query("terrain_bias")
def _(spark, sf):
    ref, tba = moved_pair(spark, sf)
    return biascorr.TerrainBias("slope", bins=20).fit(ref, tba, GRID).apply(tba, GRID)[0].select("row", "col", F.round("z", 4).alias("z"))


@query("blockwise_shifts")
def _(spark, sf):
    ref, tba = moved_pair(spark, sf)
    s = blockwise.BlockwiseCoreg(tile=64).shifts(ref, tba, GRID)
    return s.select("tile_row", "tile_col", *(F.round(c, 3).alias(c) for c in ("shift_x", "shift_y", "shift_z")))


@query("blockwise_apply")
def _(spark, sf):
    ref, tba = moved_pair(spark, sf)
    fit = blockwise.BlockwiseCoreg(tile=64, threshold=1.0, iterations=200).fit(ref, tba, GRID)
    return fit.apply(tba, GRID)[0].select("row", "col", F.round("z", 3).alias("z"))


@query("apply_rotation")
def _(spark, sf):
    ref = hills(spark, sf)
    m = resample.matrix(5.0, -5.0, 1.0, 0.05, -0.05, 0.2)
    centre = (500000.0 + 20 * 32, 8000000.0 - 20 * 250, 0.0)
    return resample.apply_to_raster(ref, GRID, np.asarray(m), centre, iterations=3)[0].select("row", "col", F.round("z", 4).alias("z"))
