"""Masks, statistics, bins and sampling of the sparse surface."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from talus.grid import Grid, crop, downsample, subtract
from talus.operators import fitting, masks, resample, stats
from talus.queries.surfaces import DENSE, PAIR, POINTS, SPARSE
from talus.sources import tables

QUERIES, SQL = {}, {}
_S = f"WITH s AS ({SPARSE})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def sparse(spark, sf):
    return tables.sparse(spark, sf).select("row", "col", "z")


@query("mask_semi", _S + ", m AS (SELECT row, col FROM s WHERE n >= 8) SELECT row, col, round(z, 6) AS z FROM s SEMI JOIN m USING (row, col)")
def _(spark, sf):
    return masks.include(sparse(spark, sf), tables.sparse(spark, sf).where("n >= 8")).select("row", "col", *r6("z"))


@query("mask_anti", _S + ", m AS (SELECT row, col FROM s WHERE n >= 8) SELECT row, col, round(z, 6) AS z FROM s ANTI JOIN m USING (row, col)")
def _(spark, sf):
    return masks.exclude(sparse(spark, sf), tables.sparse(spark, sf).where("n >= 8")).select("row", "col", *r6("z"))


@query("mask_keep_shape", _S + " SELECT row, col, CASE WHEN row % 5 = 0 AND col % 7 <> 0 THEN round(z, 6) END AS z FROM s")
def _(spark, sf):
    s = sparse(spark, sf)
    return masks.masked(s, s.where("row % 5 = 0"), s.where("col % 7 = 0"), keep_shape=True).select("row", "col", *r6("z"))


@query("mask_union", _S + " SELECT DISTINCT row, col FROM s WHERE row % 5 = 0 OR col % 7 = 0")
def _(spark, sf):
    s = sparse(spark, sf)
    return masks.union(s.where("row % 5 = 0"), s.where("col % 7 = 0"))


@query("mask_circle_ring", _S + ", d AS (SELECT *, power(row - 50, 2) + power(col - 80, 2) AS d FROM s) SELECT row, col, CASE WHEN d < 100 THEN 'circle' ELSE 'ring' END AS part FROM d WHERE d < 100 OR (d < 400 AND NOT d < 225)")
def _(spark, sf):
    s = sparse(spark, sf)
    inner = masks.circle(s, 50, 80, 10).select("row", "col", F.lit("circle").alias("part"))
    return inner.unionByName(masks.ring(s, 50, 80, 15, 20).select("row", "col", F.lit("ring").alias("part")))


@query("mask_polygon", f"WITH p AS ({POINTS}) SELECT pid FROM p WHERE x > 100.5 AND x < 400.5 AND y < 300 AND y >= 0 AND y > x - 300.5")
def _(spark, sf):
    ring = [(100.5, 0.0), (300.5, 0.0), (400.5, 100.0), (400.5, 300.0), (100.5, 300.0)]
    return masks.inside_polygon(tables.points(spark, sf), ring).select("pid")


@query("proximity", _S + ", t AS (SELECT row, col FROM s WHERE n >= 12) SELECT s.row, s.col, round(min(sqrt(power(s.row - t.row, 2) + power(s.col - t.col, 2))), 6) AS distance FROM s LEFT JOIN t ON t.row BETWEEN s.row - 4 AND s.row + 4 AND t.col BETWEEN s.col - 4 AND s.col + 4 AND power(s.row - t.row, 2) + power(s.col - t.col, 2) <= 16 GROUP BY s.row, s.col")
def _(spark, sf):
    return masks.proximity(sparse(spark, sf), tables.sparse(spark, sf).where("n >= 12"), 4).select("row", "col", *r6("distance"))


@query("sample_hash")
def _(spark, sf):
    return masks.sample(sparse(spark, sf), 500).select("row", "col", *r6("z"))


@query("crop_window", _S + " SELECT row, col, round(z, 6) AS z FROM s WHERE row >= 10 AND row < 40 AND col >= 50 AND col < 90")
def _(spark, sf):
    return crop(sparse(spark, sf), 10, 40, 50, 90).select("row", "col", *r6("z"))


@query("downsample", _S + " SELECT CAST(row / 3 AS INTEGER) AS row, CAST(col / 3 AS INTEGER) AS col, round(z, 6) AS z FROM s WHERE row % 3 = 0 AND col % 3 = 0")
def _(spark, sf):
    return downsample(sparse(spark, sf), 3).select("row", "col", *r6("z"))


@query("raster_difference", f"WITH p AS ({PAIR}) SELECT row, col, round(z_ref - z_tba, 6) AS dh FROM p")
def _(spark, sf):
    p = tables.pair(spark, sf)
    return subtract(p.select("row", "col", F.col("z_ref").alias("z")), p.select("row", "col", F.col("z_tba").alias("z"))).select("row", "col", *r6("dh"))


@query("raster_to_points", _S + " SELECT row, col, 500000 + 20 * (col + 0.5) AS x, 8000000 - 20 * (row + 0.5) AS y, round(z, 6) AS z FROM s")
def _(spark, sf):
    grid = Grid(transform=(20.0, 0.0, 500000.0, 0.0, -20.0, 8000000.0))
    return resample.to_points(sparse(spark, sf), grid).select("pid.row", "pid.col", "x", "y", *r6("z"))


_STATS = ["mean", "median", "max", "min", "sum", "sumofsquares", "90thpercentile", "le90", "nmad", "rmse", "std", "validcount", "totalcount", "percentagevalidpoints"]
_STAT_SQL = (
    "round(avg(z), 6) AS mean, round(median(z), 6) AS median, round(max(z), 6) AS max, round(min(z), 6) AS min, round(sum(z), 6) AS sum, round(sum(z * z), 6) AS sumofsquares, "
    "round(quantile_cont(z, 0.9), 6) AS \"90thpercentile\", round((quantile_cont(z, 0.95) - quantile_cont(z, 0.05)) / 2, 6) AS le90, round(1.4826 * mad(z), 6) AS nmad, "
    "round(sqrt(avg(z * z)), 6) AS rmse, round(stddev_pop(z), 6) AS std, count(z) AS validcount, count(*) AS totalcount, round(100.0 * count(z) / count(*), 6) AS percentagevalidpoints"
)


@query("stats_by_zone", _S + f", v AS (SELECT row % 5 AS zone, CASE WHEN col % 9 > 0 THEN z END AS z FROM s) SELECT zone, {_STAT_SQL} FROM v GROUP BY zone")
def _(spark, sf):
    v = sparse(spark, sf).select((F.col("row") % 5).alias("zone"), F.when(F.col("col") % 9 > 0, F.col("z")).alias("z"))
    s = stats.statistics(v, "z", _STATS, ["zone"])
    return s.select("zone", *(F.round(n, 6).alias(n) if n not in ("validcount", "totalcount") else F.col(n) for n in _STATS))


@query("stats_all", f"WITH s AS ({DENSE}) SELECT {_STAT_SQL} FROM s")
def _(spark, sf):
    s = stats.statistics(tables.dense(spark, sf), "z", _STATS)
    return s.select(*(F.round(n, 6).alias(n) if n not in ("validcount", "totalcount") else F.col(n) for n in _STATS))


@query("nmad_by_zone", _S + " SELECT row % 5 AS zone, count(z) AS n, round(median(z), 6) AS median, round(1.4826 * mad(z), 6) AS nmad FROM s GROUP BY zone")
def _(spark, sf):
    v = sparse(spark, sf).withColumn("zone", F.col("row") % 5)
    return stats.nmad(v, "z", ["zone"]).select("zone", "n", *r6("median", "nmad"))


@query("histogram_300", f"WITH p AS ({PAIR}), d AS (SELECT z_ref - z_tba AS dh FROM p), e AS (SELECT min(dh) AS lo, max(dh) AS hi FROM d) SELECT CAST(least(299, floor((dh - lo) / (hi - lo) * 300)) AS INTEGER) AS bin, count(*) AS count FROM d, e GROUP BY 1")
def _(spark, sf):
    dh = tables.pair(spark, sf).select((F.col("z_ref") - F.col("z_tba")).alias("dh"))
    return stats.histogram(dh, "dh").select("bin", "count")


@query("row_profile", _S + " SELECT row, CASE WHEN 2 * count(v) >= count(*) THEN round(avg(v), 6) END AS mean, count(v) AS valid FROM (SELECT row, CASE WHEN (row + col) % 4 < row % 4 THEN z END AS v FROM s) GROUP BY row")
def _(spark, sf):
    v = sparse(spark, sf).withColumn("z", F.when((F.col("row") + F.col("col")) % 4 < F.col("row") % 4, F.col("z")))
    return stats.profiles(v, "row").select("row", *r6("mean"), "valid")


EDGES = {"z": [float(e) for e in range(0, 110, 10)], "col": [30.0, 50.0, 60.0, 90.0, 120.0]}


def _bin_sql(x: str, edges: list[float]) -> str:
    cases = " ".join(f"WHEN {x} < {e} THEN {k}" for k, e in enumerate(edges[1:-1]))
    return f"CASE WHEN {x} < {edges[0]} OR {x} > {edges[-1]} THEN NULL {cases} ELSE {len(edges) - 2} END"


def _edge_sql(b: str, edges: list[float], shift: int) -> str:
    return "CASE " + " ".join(f"WHEN {b} = {k} THEN {edges[k + shift]}" for k in range(len(edges) - 1)) + " END"


_B = f"{_S}, b AS (SELECT n * 1.0 AS v, {_bin_sql('z', EDGES['z'])} AS bz, {_bin_sql('col', EDGES['col'])} AS bc FROM s)"


@query(
    "bin_grouping_sets",
    _B + ", g AS (SELECT bz, bc, count(v) AS count, median(v) AS nanmedian, 1.4826 * mad(v) AS nmad, 2 - grouping(bz) - grouping(bc) AS nd FROM b GROUP BY GROUPING SETS ((bz), (bc), (bz, bc)) "
    "HAVING (grouping(bz) = 1 OR bz IS NOT NULL) AND (grouping(bc) = 1 OR bc IS NOT NULL)) "
    f"SELECT CAST(nd AS INTEGER) AS nd, CAST({_edge_sql('bz', EDGES['z'], 0)} AS DOUBLE) AS z_left, CAST({_edge_sql('bz', EDGES['z'], 1)} AS DOUBLE) AS z_right, CAST({_edge_sql('bc', EDGES['col'], 0)} AS DOUBLE) AS col_left, count, round(nanmedian, 6) AS nanmedian, round(nmad, 6) AS nmad FROM g",
)
def _(spark, sf):
    s = tables.sparse(spark, sf).withColumn("v", F.col("n") * 1.0)
    b = stats.nd_binning(s, "v", EDGES)
    return b.select("nd", F.col("z.left").alias("z_left"), F.col("z.right").alias("z_right"), F.col("col.left").alias("col_left"), "count", *r6("nanmedian", "nmad"))


@query("perbin_lookup", _B + ", m AS (SELECT bz, bc, median(v) AS m, count(v) AS k FROM b WHERE bz IS NOT NULL AND bc IS NOT NULL GROUP BY bz, bc HAVING count(v) > 3), c AS (SELECT row, col, z, " + f"CASE WHEN z >= 100 OR col >= 120 THEN NULL ELSE {_bin_sql('z', EDGES['z'])} END AS bz, {_bin_sql('col', EDGES['col'])} AS bc FROM s) SELECT row, col, round(m, 6) AS nanmedian FROM c LEFT JOIN m ON c.bz = m.bz AND c.bc = m.bc")
def _(spark, sf):
    s = tables.sparse(spark, sf).withColumn("v", F.col("n") * 1.0)
    return stats.perbin_lookup(s, stats.nd_binning(s, "v", EDGES), ["z", "col"], "nanmedian", 3).select("row", "col", *r6("nanmedian"))


@query("standardize", f"WITH p AS ({PAIR}), d AS (SELECT row, col, (z_ref - z_tba) / (1 + abs(z_ref) / 50) AS z FROM p), f AS (SELECT 1.4826 * mad(z) AS m FROM d), k AS (SELECT row, col, CASE WHEN abs(z) <= 3 * m THEN z END AS z FROM d, f), g AS (SELECT 1.4826 * mad(z) AS m FROM k) SELECT row, col, round(z / m, 6) AS z FROM k, g")
def _(spark, sf):
    d = tables.pair(spark, sf).withColumn("dh", F.col("z_ref") - F.col("z_tba"))
    out, _factor = stats.two_step_standardization(d, "dh", 1 + F.abs("z_ref") / 50, 3.0)
    return out.select("row", "col", *r6("z"))


@query("heteroscedasticity")
def _(spark, sf):
    d = tables.pair(spark, sf).withColumn("dh", F.col("z_ref") - F.col("z_tba"))
    out, *_rest = stats.heteroscedasticity(d, "dh", {"z_ref": [0.0, 20.0, 30.0, 40.0, 50.0, 60.0, 110.0]}, 30)
    return out.select("row", "col", *r6("sigma"))


@query("interval_parse", "SELECT k, CAST(k AS DOUBLE) AS \"left\", k + 2.5 AS \"right\" FROM (SELECT unnest(range(0, 20)) AS k)")
def _(spark, sf):
    text = F.concat(F.lit("["), F.col("id"), F.lit(", "), F.col("id") + 2.5, F.lit(")"))
    return spark.range(20).select(F.col("id").alias("k"), stats.interval_column(text).alias("i")).select("k", "i.left", "i.right")


@query("losses", f"WITH p AS ({PAIR}), r AS (SELECT z_ref - z_tba AS r FROM p) SELECT round(sqrt(avg(r * r)), 6) AS rmse, round(sum(CASE WHEN abs(r) <= 1.35 THEN 0.5 * r * r ELSE 1.35 * (abs(r) - 0.675) END), 4) AS huber, round(sum(0.5 * (sqrt(1 + 4 * r * r) - 1)), 4) AS soft FROM r")
def _(spark, sf):
    a, b = F.col("z_ref"), F.col("z_tba")
    return tables.pair(spark, sf).agg(F.round(fitting.rmse(a, b), 6).alias("rmse"), F.round(fitting.huber_loss(a, b), 4).alias("huber"), F.round(fitting.soft_loss(a, b), 4).alias("soft"))


@query("polynomial_columns", f"WITH s AS ({SPARSE}) SELECT row, col, round(1 + 2 * col - 0.01 * col * col, 6) AS p1, round(1 + 3 * row + 2 * col + 0.5 * row * col, 6) AS p2, round(2 * sin(2 * pi() / 12 * col + 0.3) + sin(2 * pi() / 5 * col), 6) AS s2 FROM s")
def _(spark, sf):
    c, r = F.col("col").cast("double"), F.col("row").cast("double")
    p2 = fitting.polynomial_2d(c, r, [[1, 3], [2, 0.5]])
    return sparse(spark, sf).select("row", "col", F.round(fitting.polynomial_1d(c, [1, 2, -0.01]), 6).alias("p1"), F.round(p2, 6).alias("p2"), F.round(fitting.sum_of_sines(c, [2, 12, 0.3, 1, 5, 0]), 6).alias("s2"))


_G = "regr_slope(z, col)"


@query("linear_gram", _S + " SELECT round(regr_intercept(z, col), 6) AS c0, round(regr_slope(z, col), 6) AS c1, count(*) AS n FROM s")
def _(spark, sf):
    s = sparse(spark, sf)
    x = F.col("col") / 100.0
    c = fitting.linear_fit(s, [F.lit(1.0), x], F.col("z"))
    return s.agg(F.round(F.lit(float(c[0])), 6).alias("c0"), F.round(F.lit(float(c[1]) / 100.0), 6).alias("c1"), F.count("*").alias("n"))


@query("polynomial_robust")
def _(spark, sf):
    s = sparse(spark, sf)
    c, order = fitting.fit_polynomial(s, "col", "z", 4)
    return spark.createDataFrame([(order, [round(v, 6) for v in c])], "order int, coefficients array<double>")


@query("bilinear_shift", f"WITH s AS ({DENSE}) SELECT t.row, t.col, round(0.75 * (0.4 * a.z + 0.6 * b.z) + 0.25 * (0.4 * c.z + 0.6 * d.z), 6) AS z FROM s t LEFT JOIN s a ON a.row = t.row - 1 AND a.col = t.col + 2 LEFT JOIN s b ON b.row = t.row - 1 AND b.col = t.col + 1 LEFT JOIN s c ON c.row = t.row - 2 AND c.col = t.col + 2 LEFT JOIN s d ON d.row = t.row - 2 AND d.col = t.col + 1")
def _(spark, sf):
    return resample.shift(tables.dense(spark, sf), 1.25, -1.4).select("row", "col", *r6("z"))


@query("interp_points", f"WITH s AS ({DENSE}), p AS (SELECT pid, x / 4 + 0.13 AS c, y - floor(y / 400) * 400 AS r FROM ({POINTS})), q AS (SELECT *, floor(r) AS r0, floor(c) AS c0 FROM p) SELECT q.pid, round((1 - (r - r0)) * ((1 - (c - c0)) * a.z + (c - c0) * b.z) + (r - r0) * ((1 - (c - c0)) * d.z + (c - c0) * e.z), 6) AS z FROM q LEFT JOIN s a ON a.row = r0 AND a.col = c0 LEFT JOIN s b ON b.row = r0 AND b.col = c0 + 1 LEFT JOIN s d ON d.row = r0 + 1 AND d.col = c0 LEFT JOIN s e ON e.row = r0 + 1 AND e.col = c0 + 1")
def _(spark, sf):
    p = tables.points(spark, sf)
    p = p.select("pid", (F.col("x") / 4 + 0.13).alias("pcol"), (F.col("y") - F.floor(F.col("y") / 400) * 400).alias("prow"))
    return resample.interp(p, tables.dense(spark, sf), {"z": "z"}).select("pid", *r6("z"))


@query("regrid_nearest", f"WITH s AS ({DENSE}), t AS (SELECT row, col FROM s) SELECT t.row, t.col, round(s.z, 6) AS z FROM t LEFT JOIN s ON s.row = 3 * t.row + 1 AND s.col = 3 * t.col + 1")
def _(spark, sf):
    s = tables.dense(spark, sf)
    out = resample.reproject(s, Grid(), Grid(transform=(3.0, 0.0, 0.0, 0.0, -3.0, 0.0)), s.select("row", "col"), "nearest")
    return out.select("row", "col", *r6("z"))


_ANGLE = math.radians(30.0)


@query("affine_points", f"WITH p AS ({POINTS}) SELECT pid, round(cos({_ANGLE!r}) * (x - 10) - sin({_ANGLE!r}) * (y - 20) + 10 + 1, 6) AS x, round(sin({_ANGLE!r}) * (x - 10) + cos({_ANGLE!r}) * (y - 20) + 20 - 2, 6) AS y, round(z + 3, 6) AS z FROM p")
def _(spark, sf):
    m = resample.matrix(1.0, -2.0, 3.0, 0.0, 0.0, 30.0)
    return resample.apply_to_points(tables.points(spark, sf), m, (10.0, 20.0, 0.0)).select("pid", *r6("x", "y", "z"))
