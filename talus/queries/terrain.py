"""Terrain attributes of the dense surface (20 m cells)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import terrain as T
from talus.operators import terrain as op
from talus.queries.surfaces import DENSE
from talus.sources import tables

RES = 20.0


def _query(name: str, **options):
    def run(spark, sf_dir):
        out = op.terrain_attributes(tables.dense(spark, sf_dir), name, RES, **options)
        return out.select("row", "col", F.round(name, 6).alias("value"))

    return run


def _window(radius: int) -> str:
    """A query for row, col and neighbours z{i}{j} of the dense surface, by shifts along rows, then columns."""
    n = 2 * radius + 1
    move = lambda v, k, by, order: v if k == 0 else f"{'lag' if k < 0 else 'lead'}({v}, {abs(k)}) OVER (PARTITION BY {by} ORDER BY {order})"
    wide = ", ".join(f"{move('z', j - radius, 'row', 'col')} AS c{j}" for j in range(n))
    tall = ", ".join(f"{move(f'c{j}', i - radius, 'col', 'row')} AS z{i}{j}" for i in range(n) for j in range(n))
    return f"SELECT row, col, {tall} FROM (SELECT row, col, {wide} FROM ({DENSE}))"


def _fitted_sql(name: str, fit: str, **options) -> str:
    r = T.radius(fit)
    parts = ", ".join(f"{e} AS {k}" for k, e in T.derivatives(fit, RES).items())
    value = T.surface(name, **options)
    return (
        f"WITH w AS ({_window(r)}), d AS (SELECT row, col, {T.whole(r)} AS c, {parts} FROM w) "
        f"SELECT row, col, CASE WHEN c IS NOT NULL THEN round({value}, 6) END AS value FROM d"
    )


def _window_sql(expression: str, radius: int) -> str:
    return f"WITH w AS ({_window(radius)}) SELECT row, col, round(CASE WHEN {T.whole(radius)} IS NOT NULL THEN {expression} END, 6) AS value FROM w"


def _box_sql(expression: str, w: int) -> str:
    k = w // 2
    near = f"SELECT a.row, a.col, a.z, sum(b.z) AS total, min(b.z) AS lo, max(b.z) AS hi, count(b.z) AS n FROM s a JOIN s b ON b.row BETWEEN a.row - {k} AND a.row + {k} AND b.col BETWEEN a.col - {k} AND a.col + {k} GROUP BY a.row, a.col, a.z"
    return f"WITH s AS ({DENSE}) SELECT row, col, CASE WHEN n = {w * w} THEN round({expression}, 6) END AS value FROM ({near})"


def _profile(spark, sf_dir):
    """Mean slope by row."""
    out = op.terrain_attributes(tables.dense(spark, sf_dir), "slope", RES, surface_fit="ZevenbergThorne")
    return out.groupBy("row").agg(F.round(F.avg("slope"), 6).alias("mean_slope"), F.count("slope").alias("n"))


QUERIES = {"slope_profile": _profile}
SQL = {"slope_profile": f"SELECT row, round(avg(value), 6) AS mean_slope, count(value) AS n FROM ({_fitted_sql('slope', 'ZevenbergThorne').replace('round(', '(', 1).replace(', 6) END', ') END', 1)}) GROUP BY row"}

for _fit, _short in (("Horn", "horn"), ("ZevenbergThorne", "zt"), ("Florinsky", "florinsky")):
    for _name in T.SURFACE:
        QUERIES[f"{_name}_{_short}"] = _query(_name, surface_fit=_fit)
        SQL[f"{_name}_{_short}"] = _fitted_sql(_name, _fit)
QUERIES["hillshade_z2"] = _query("hillshade", surface_fit="Horn", hillshade_azimuth=200.0, hillshade_altitude=30.0, hillshade_z_factor=2.0)
SQL["hillshade_z2"] = _fitted_sql("hillshade", "Horn", azimuth=200.0, altitude=30.0, z_factor=2.0)
for _name in T.CURVATURES:
    _label = _name.replace("_curvature", "")
    if _name == "curvature":
        QUERIES["curv_total"] = _query(_name, surface_fit="ZevenbergThorne")
        SQL["curv_total"] = _fitted_sql(_name, "ZevenbergThorne")
        continue
    for _method, _short in (("geometric", "geom"), ("directional", "dir")):
        QUERIES[f"curv_{_label}_{_short}"] = _query(_name, curv_method=_method)
        SQL[f"curv_{_label}_{_short}"] = _fitted_sql(_name, "Florinsky", method=_method)
QUERIES["curv_max_zt"] = _query("max_curvature", surface_fit="ZevenbergThorne")
SQL["curv_max_zt"] = _fitted_sql("max_curvature", "ZevenbergThorne", method="geometric")
for _w in (3, 5):
    QUERIES[f"tpi{_w}"] = _query("topographic_position_index", window_size=_w)
    SQL[f"tpi{_w}"] = _box_sql(f"z - (total - z) / {_w * _w - 1}", _w)
    QUERIES[f"roughness{_w}"] = _query("roughness", window_size=_w)
    SQL[f"roughness{_w}"] = _box_sql("hi - lo", _w)
    for _tri in ("Riley", "Wilson"):
        QUERIES[f"tri_{_tri.lower()}{_w}"] = _query("terrain_ruggedness_index", tri_method=_tri, window_size=_w)
        SQL[f"tri_{_tri.lower()}{_w}"] = _window_sql(T.ruggedness(_tri, _w), _w // 2)
QUERIES["rugosity"] = _query("rugosity")
SQL["rugosity"] = _window_sql(T.rugosity(RES), 1)
QUERIES["fractal_roughness"] = _query("fractal_roughness")
QUERIES["texture_shading"] = _query("texture_shading")


def _all_attributes(spark, sf_dir):
    """Several attributes of one plan: slope, aspect, and two curvatures share their derivatives."""
    names = ["slope", "aspect", "max_curvature", "min_curvature"]
    out = op.terrain_attributes(tables.dense(spark, sf_dir), names, RES)
    return out.select("row", "col", *(F.round(n, 6).alias(n) for n in names))


QUERIES["attributes_shared"] = _all_attributes
_parts = ", ".join(f"{e} AS {k}" for k, e in T.derivatives("Florinsky", RES).items())
_values = ", ".join(f"CASE WHEN c IS NOT NULL THEN round({T.surface(n)}, 6) END AS {n}" for n in ("slope", "aspect", "max_curvature", "min_curvature"))
SQL["attributes_shared"] = f"WITH w AS ({_window(2)}), d AS (SELECT row, col, {T.whole(2)} AS c, {_parts} FROM w) SELECT row, col, {_values} FROM d"


def _mean(shape: str, size: int):
    def run(spark, sf_dir):
        out = op.mean_filter(tables.sparse(spark, sf_dir).select("row", "col", "z"), size, shape)
        return out.select("row", "col", F.round("mean", 6).alias("mean"), F.col("n").cast("long").alias("n"), F.col("kernel_size").cast("long").alias("kernel_size"))

    return run


from talus.queries.surfaces import SPARSE  # noqa: E402

QUERIES["mean_filter_square"] = _mean("square", 3)
QUERIES["mean_filter_circular"] = _mean("circular", 5)
SQL["mean_filter_square"] = f"WITH s AS ({SPARSE}) SELECT a.row, a.col, round(avg(b.z), 6) AS mean, count(b.z) AS n, CAST(9 AS BIGINT) AS kernel_size FROM s a JOIN s b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col"
SQL["mean_filter_circular"] = f"WITH s AS ({SPARSE}) SELECT a.row, a.col, round(avg(b.z), 6) AS mean, count(b.z) AS n, CAST(21 AS BIGINT) AS kernel_size FROM s a JOIN s b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 AND power(b.row - a.row, 2) + power(b.col - a.col, 2) < 6.25 GROUP BY a.row, a.col"


def _convolved(spark, sf_dir):
    kernels = {"edge": [[1, 0, -1], [2, 0, -2], [1, 0, -1]], "mean": [[1 / 9] * 3] * 3}
    out = op.convolution(tables.dense(spark, sf_dir), kernels)
    return out.select("row", "col", F.round("edge", 6).alias("edge"), F.round("mean", 6).alias("mean"))


QUERIES["convolution"] = _convolved
SQL["convolution"] = f"WITH w AS ({_window(1)}) SELECT row, col, round(CASE WHEN {T.whole(1)} IS NOT NULL THEN z02 - z00 + 2 * z12 - 2 * z10 + z22 - z20 END, 6) AS edge, round(CASE WHEN {T.whole(1)} IS NOT NULL THEN (z00 + z01 + z02 + z10 + z11 + z12 + z20 + z21 + z22) / 9 END, 6) AS mean FROM w"
