"""Variograms, effective samples, propagation of errors, patches, and vertical references."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from talus.grid import Grid
from talus.operators import geostat, vertical
from talus.queries.statistics import r6
from talus.queries.surfaces import DENSE, PAIR, POINTS, SPARSE
from talus.sources import tables

QUERIES, SQL = {}, {}
MODELS = [{"model": "spherical", "range": 50.0, "psill": 0.7}, {"model": "exponential", "range": 400.0, "psill": 0.2}, {"model": "gaussian", "range": 90.0, "psill": 0.1}]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NEAR = [1.0, 1.5, 2.0, 3.0]
_PAIRS = f"WITH s AS ({SPARSE}), d AS (SELECT CASE {' '.join(f'WHEN h <= {e} THEN {e}' for e in NEAR)} END AS lags, dz FROM (SELECT sqrt(power(a.row - b.row, 2) + power(a.col - b.col, 2)) AS h, abs(a.z - b.z) AS dz FROM s a JOIN s b ON b.row BETWEEN a.row AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 AND (b.row > a.row OR b.col > a.col)) WHERE h <= 3)"


def _near(estimator: str):
    def run(spark, sf):
        v = geostat.near_variogram(tables.sparse(spark, sf).select("row", "col", "z"), NEAR, estimator)
        return v.select("lags", *r6("exp"), "count")

    return run


def _near_sql(value: str) -> str:
    return _PAIRS + f" SELECT CAST(lags AS DOUBLE) AS lags, round({value}, 6) AS exp, count(*) AS count FROM d GROUP BY lags"


for _name, _value in (
    ("matheron", "avg(dz * dz) / 2"),
    ("dowd", "2.198 * median(dz) * median(dz) / 2"),
    ("cressie", "power(avg(sqrt(dz)), 4) / (0.457 + 0.494 / count(*) + 0.045 / power(count(*), 2)) / 2"),
):
    QUERIES[f"vario_{_name}"] = _near(_name)
    SQL[f"vario_{_name}"] = _near_sql(_value)
QUERIES["vario_genton"] = _near("genton")


@query("vario_pdist")
def _(spark, sf):
    v = geostat.variogram(tables.points(spark, sf), geostat.lag_edges(5.0, 1500.0), "matheron", 1000, runs=2)
    return v.select(*r6("lags", "exp", "err_exp"), "count")


@query("vario_equidistant")
def _(spark, sf):
    v = geostat.variogram(tables.points(spark, sf), geostat.lag_edges(5.0, 1500.0), "matheron", 2000, "cdist_equidistant", runs=4)
    return v.select(*r6("lags", "exp", "err_exp"), "count")


@query("vario_fit")
def _(spark, sf):
    h = [10.0 * k for k in range(1, 60)]
    t = pd.DataFrame({"lags": h, "exp": geostat.gamma(MODELS[:2], __import__("numpy").array(h)), "err_exp": float("nan")})
    fitted = geostat.fit_models(["spherical", "exponential"], t)
    return spark.createDataFrame([(m["model"], round(m["range"], 2), round(m["psill"], 3)) for m in fitted], "model string, range double, psill double")


def _gamma_sql(h: str) -> str:
    return f"(0.7 * (CASE WHEN {h} < 50 THEN 1.5 * {h} / 50 - 0.5 * power({h} / 50, 3) ELSE 1 END) + 0.2 * (1 - exp(-3 * {h} / 400)) + 0.1 * (1 - exp(-4 * power({h} / 90, 2))))"


@query("vario_models", f"SELECT h, round({_gamma_sql('h')}, 6) AS gamma, round(1 - {_gamma_sql('h')}, 6) AS covariance FROM (SELECT CAST(k AS DOUBLE) AS h FROM (SELECT unnest(range(0, 600, 5)) AS k))")
def _(spark, sf):
    h = F.col("h")
    d = spark.range(0, 600, 5).select(F.col("id").cast("double").alias("h"))
    return d.select("h", F.round(geostat.gamma(MODELS, h), 6).alias("gamma"), F.round(geostat.covariance(MODELS, h), 6).alias("covariance"))


_NEFF = "(1.0 / (CASE WHEN l <= 50 THEN 0.7 * (1 - l / 50 + power(l / 50, 3) / 5) ELSE 0.7 / 5 * power(50 / l, 2) END + 2 * 0.2 * power(400 / 3.0 / l, 2) * (1 - exp(-l / (400 / 3.0)) * (1 + l / (400 / 3.0))) + 0.1 * power(45 / l, 2) * (1 - exp(-power(l / 45, 2)))))"


@query("neff_circular", f"SELECT area, round({_NEFF}, 6) AS n_eff FROM (SELECT area, sqrt(area / pi()) AS l FROM (SELECT CAST(k AS DOUBLE) * 100 AS area FROM (SELECT unnest(range(1, 2000, 7)) AS k)))")
def _(spark, sf):
    d = spark.range(1, 2000, 7).select((F.col("id").cast("double") * 100).alias("area"))
    return d.select("area", F.round(geostat.neff_circular(F.col("area"), MODELS), 6).alias("n_eff"))


@query("neff_numerical", f"SELECT area, round({_NEFF}, 6) AS n_eff FROM (SELECT area, sqrt(area / pi()) AS l FROM (SELECT unnest([100.0::DOUBLE, 5000.0::DOUBLE, 90000.0::DOUBLE]) AS area))")
def _(spark, sf):
    rows = [(float(a), round(geostat.neff_numerical(a, MODELS), 6)) for a in (100.0, 5000.0, 90000.0)]
    return spark.createDataFrame(rows, "area double, n_eff double")


_EXACT = "WITH p AS (SELECT s_suppkey % 25 * 10.0 AS x, floor(s_suppkey / 25) * 10.0 AS y, 1 + abs(s_acctbal) / 10000 AS err FROM supplier)"


def _suppliers(spark, sf):
    """Suppliers laid out on a lattice, with errors from their balances."""
    k = F.col("s_suppkey")
    return tables.read(spark, sf, "supplier").select(k.alias("pid"), (k % 25 * 10.0).alias("x"), (F.floor(k / 25) * 10.0).alias("y"), (1 + F.abs("s_acctbal") / 10000).alias("err"))


@query("neff_exact", _EXACT + f", c AS (SELECT avg((1 - {_gamma_sql('h')}) * e) AS v FROM (SELECT sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS h, a.err * b.err AS e FROM p a, p b)) SELECT round(power((SELECT avg(err) FROM p), 2) / v, 4) AS n_eff FROM c")
def _(spark, sf):
    return spark.createDataFrame([(round(geostat.neff_all_pairs(_suppliers(spark, sf), MODELS), 4),)], "n_eff double")


@query("neff_subsample")
def _(spark, sf):
    return spark.createDataFrame([(round(geostat.neff_exact(_suppliers(spark, sf), MODELS, 100), 4),)], "n_eff double")


@query("error_propagation", f"WITH s AS ({SPARSE}), z AS (SELECT row % 5 AS zone, avg(1 + z / 50) AS mean_sigma, count(*) * 4.0 AS area FROM s GROUP BY 1), n AS (SELECT *, sqrt(area / pi()) AS l FROM z) SELECT zone, round(mean_sigma, 6) AS mean_sigma, area, round({_NEFF}, 6) AS n_eff, round(mean_sigma / sqrt({_NEFF}), 6) AS standard_error FROM n")
def _(spark, sf):
    s = tables.sparse(spark, sf).select((F.col("row") % 5).alias("zone"), (1 + F.col("z") / 50).alias("sigma"))
    return geostat.propagate(s, MODELS, 4.0).select("zone", *r6("mean_sigma"), "area", *r6("n_eff", "standard_error"))


#: A stable model of smoothness 1 and a Matern model of smoothness 1/2 are exponential models, whose integral is known.
_EXPONENTIAL = "(1 / (2 * power(60 / 3.0 / l, 2) * (1 - exp(-l / (60 / 3.0)) * (1 + l / (60 / 3.0)))))"


@query("error_propagation_stable", f"WITH s AS ({SPARSE}), z AS (SELECT row % 5 AS zone, avg(1 + z / 50) AS mean_sigma, count(*) * 4.0 AS area FROM s GROUP BY 1), n AS (SELECT *, sqrt(area / pi()) AS l FROM z) SELECT zone, round(mean_sigma, 6) AS mean_sigma, area, round({_EXPONENTIAL}, 4) AS n_eff, round(mean_sigma / sqrt({_EXPONENTIAL}), 4) AS standard_error FROM n")
def _(spark, sf):
    """Errors of zones under a model whose effective samples are integrated numerically."""
    s = tables.sparse(spark, sf).select((F.col("row") % 5).alias("zone"), (1 + F.col("z") / 50).alias("sigma"))
    got = geostat.propagate(s, [{"model": "stable", "range": 60.0, "psill": 1.5, "smooth": 1.0}], 4.0)
    return got.select("zone", *r6("mean_sigma"), "area", F.round("n_eff", 4).alias("n_eff"), F.round("standard_error", 4).alias("standard_error"))


@query("standard_errors", "SELECT k, round(2 / sqrt(k), 6) AS se, round(2 * sqrt((1 - k / 500.0) / k), 6) AS se_finite FROM (SELECT CAST(unnest(range(1, 500, 3)) AS BIGINT) AS k)")
def _(spark, sf):
    k = F.col("k")
    d = spark.range(1, 500, 3).select(F.col("id").alias("k"))
    return d.select("k", F.round(geostat.standard_error(F.lit(2.0), k), 6).alias("se"), F.round(geostat.standard_error_finite(F.lit(2.0), 500.0, k), 6).alias("se_finite"))


@query("haversine", f"WITH p AS (SELECT pid, y / 20 - 20 AS lat, x / 20 AS lon FROM ({POINTS})) SELECT pid, round(2 * 6373000.0 * asin(least(1.0, sqrt(power(sin((radians(45.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(45.0)) * power(sin((radians(7.0) - radians(lon)) / 2), 2)))), 4) AS metres FROM p")
def _(spark, sf):
    p = tables.points(spark, sf).select("pid", (F.col("y") / 20 - 20).alias("lat"), (F.col("x") / 20).alias("lon"))
    return p.select("pid", F.round(geostat.haversine(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(7.0)), 4).alias("metres"))


@query("patches_square", f"WITH s AS ({SPARSE}), m AS (SELECT a.row, a.col, avg(b.z) AS mean, count(b.z) AS n FROM s a JOIN s b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col) SELECT row % 3 AS i, col % 3 AS j, count(*) AS n, round(1.4826 * mad(mean), 6) AS nmad FROM m WHERE n * 100.0 >= 80.0 * 9 GROUP BY 1, 2")
def _(spark, sf):
    from talus.operators.stats import nmad

    laid, _value = geostat.patches(tables.sparse(spark, sf).select("row", "col", "z"), 3)
    return nmad(laid, "mean", ["i", "j"]).select("i", "j", "n", *r6("nmad"))


_PATCHES = (
    f"WITH s AS ({SPARSE}), k(size, cells) AS (VALUES (3, 9), (5, 21))"
    """, m AS (SELECT k.size, k.cells, a.row, a.col, avg(b.z) AS mean, count(b.z) AS n FROM k, s a JOIN s b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2
  WHERE abs(a.row - b.row) <= k.size // 2 AND abs(a.col - b.col) <= k.size // 2 AND power(a.row - b.row, 2) + power(a.col - b.col, 2) < power(k.size / 2.0, 2) GROUP BY 1, 2, 3, 4),
g AS (SELECT size, row % size AS i, col % size AS j, 1.4826 * mad(mean) AS nmad, count(*) AS n FROM m WHERE n * 100.0 >= 80.0 * cells GROUP BY 1, 2, 3)
SELECT CAST(size * size AS DOUBLE) AS areas, CAST(size * size AS DOUBLE) AS exact_areas, CAST(coalesce(sum(n) FILTER (WHERE i = 0 AND j = 0), 0) AS BIGINT) AS n, round(avg(nmad), 6) AS nmad FROM g GROUP BY size"""
)


@query("patches_areas", _PATCHES)
def _(spark, sf):
    t = geostat.patches_method(tables.sparse(spark, sf).select("row", "col", "z"), [9.0, 25.0], shape="circular")
    return spark.createDataFrame([(float(r.areas), float(r.exact_areas), int(r.nb_indep_patches), round(float(r.nmad), 6)) for r in t.itertuples()], "areas double, exact_areas double, n long, nmad double")


@query("geoid_to_ellipsoid", f"WITH s AS ({DENSE}) SELECT row, col, round(z + 10 + 0.5 * (row / 8.0) - 0.25 * (col / 8.0), 6) AS z FROM s")
def _(spark, sf):
    """Geoid to ellipsoid heights, with a plane of undulations on cells eight times as wide."""
    s = tables.dense(spark, sf)
    geoid = s.select("row", "col", (10 + 0.5 * F.col("row") - 0.25 * F.col("col")).alias("z"))
    coarse = Grid(transform=(8.0, 0.0, 0.0, 0.0, -8.0, 0.0), area_or_point="Point")
    fine = Grid(area_or_point="Point", vcrs="EGM96")
    out, _grid = vertical.to_vcrs(s, fine, "Ellipsoid", {"EGM96": (geoid, coarse)})
    return out.select("row", "col", *r6("z"))


@query("product_references", "SELECT * FROM (VALUES ('AW3D30', 'EGM96'), ('COPDEM', 'EGM08'), ('TDM1', 'Ellipsoid'), ('unknown', NULL)) t(product, vcrs)")
def _(spark, sf):
    return spark.createDataFrame([(p, vertical.of_product(p)) for p in ("AW3D30", "COPDEM", "TDM1", "unknown")], "product string, vcrs string")


@query("error_pipeline")
def _(spark, sf):
    """Errors of the pair by height, standardised differences, their variogram, and the error of zones' means."""
    from talus.operators.stats import heteroscedasticity, two_step_standardization

    d = tables.pair(spark, sf).withColumn("dh", F.col("z_ref") - F.col("z_tba"))
    with_sigma, _bins, f = heteroscedasticity(d, "dh", {"z_ref": [0.0, 25.0, 35.0, 45.0, 55.0, 110.0]}, 30, stable=F.col("row") % 5 == 0)
    z, _factor = two_step_standardization(with_sigma.where("row % 5 = 0"), "dh", F.col("sigma"))
    p = z.where("z is not null").select(F.struct("row", "col").alias("pid"), F.col("col").cast("double").alias("x"), (-F.col("row")).cast("double").alias("y"), "z")
    v = geostat.variogram(p, geostat.lag_edges(2.0, 90.0), "dowd").toPandas()
    models = geostat.fit_models(["gaussian", "spherical"], v)
    zones = with_sigma.select((F.col("row") % 5).alias("zone"), "sigma")
    return geostat.propagate(zones, models, 1.0).select("zone", F.round("mean_sigma", 4).alias("mean_sigma"), "area", F.round("n_eff", 2).alias("n_eff"))
