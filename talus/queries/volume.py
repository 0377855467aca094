"""Hypsometry, filling of voids, and series of differences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from talus.operators import hypso, series
from talus.queries.least import fitted
from talus.queries.statistics import r6
from talus.queries.surfaces import PAIR, SERIES
from talus.sources import tables

QUERIES, SQL = {}, {}
#: Voids: cells whose indices add up to a multiple of six.
_VOID = "(row + col) % 6 = 0"
_D = f"WITH p AS ({PAIR}), d AS (SELECT row, col, row % 5 AS zone, z_ref AS z, CASE WHEN NOT {_VOID} THEN z_ref - z_tba END AS dh FROM p)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def change(spark, sf):
    """row, col, zone, z and dh with voids."""
    p = tables.pair(spark, sf)
    dh = F.when(~F.expr(_VOID), F.col("z_ref") - F.col("z_tba"))
    return p.select("row", "col", (F.col("row") % 5).alias("zone"), F.col("z_ref").alias("z"), dh.alias("dh"))


def _bins_sql(edges: str, n: str) -> str:
    return f"{_D}, e AS (SELECT min(z) AS lo, max(z) AS hi FROM d), x AS (SELECT k AS bin, {edges} AS edge FROM (SELECT unnest(range(0, CAST({n} AS BIGINT) + 1)) AS k, lo, hi FROM e)), b AS (SELECT bin, edge AS l, lead(edge) OVER (ORDER BY bin) AS r FROM x), t AS (SELECT CAST(bin AS INTEGER) AS bin, l, r, median(dh) AS value, count(dh) AS n FROM b LEFT JOIN d ON z >= l AND z < r WHERE r IS NOT NULL GROUP BY bin, l, r)"


_FIXED = _bins_sql("lo + 10.0 * k", "(SELECT ceil((hi - lo + 10 + 1e-6) / 10) - 1 FROM e)").replace("SELECT unnest(range(0, CAST((SELECT ceil((hi - lo + 10 + 1e-6) / 10) - 1 FROM e) AS BIGINT) + 1)) AS k, lo, hi FROM e", "SELECT unnest(range(0, CAST(ceil((hi - lo + 10 + 1e-6) / 10) AS BIGINT))) AS k, lo, hi FROM e")
_COUNT = _bins_sql("lo + (hi + 1e-6 / 8 - lo) * k / 8", "8")
_OUT = ' SELECT bin, round(l, 6) AS "left", round(r, 6) AS "right", round(value, 6) AS value, n AS count FROM t'


def _shown(t):
    return t.select("bin", *r6("left", "right", "value"), F.col("count"))


@query("hypso_fixed", _FIXED + _OUT)
def _(spark, sf):
    return _shown(hypso.hypsometric_binning(change(spark, sf), 10.0))


@query("hypso_count", _COUNT + _OUT)
def _(spark, sf):
    return _shown(hypso.hypsometric_binning(change(spark, sf), 8, "count"))


@query("hypso_quantile", _D + ", q AS (SELECT unnest(range(0, 5)) AS bin, unnest([quantile_cont(z, 0.0), quantile_cont(z, 0.25), quantile_cont(z, 0.5), quantile_cont(z, 0.75), quantile_cont(z, 1.0) + 1e-6]) AS edge FROM d), b AS (SELECT bin, edge AS l, lead(edge) OVER (ORDER BY bin) AS r FROM q), t AS (SELECT CAST(bin AS INTEGER) AS bin, l, r, median(dh) AS value, count(dh) AS n FROM b LEFT JOIN d ON z >= l AND z < r WHERE r IS NOT NULL GROUP BY bin, l, r)" + _OUT)
def _(spark, sf):
    return _shown(hypso.hypsometric_binning(change(spark, sf), 4, "quantile"))


@query("hypso_custom_mean", _D + ", b(bin, l, r) AS (VALUES (0, 0.0, 30.0), (1, 30.0, 45.0), (2, 45.0, 90.0)), t AS (SELECT bin, CAST(l AS DOUBLE) AS l, CAST(r AS DOUBLE) AS r, avg(dh) AS value, count(dh) AS n FROM b LEFT JOIN d ON z >= l AND (z < r OR (bin = 2 AND z = r)) GROUP BY bin, l, r)" + _OUT)
def _(spark, sf):
    return _shown(hypso.hypsometric_binning(change(spark, sf), [0.0, 30.0, 45.0, 90.0], "custom", None))


@query("hypso_area", _COUNT + ", a AS (SELECT t.l, t.r, count(d.z) * 400.0 AS area FROM t LEFT JOIN d ON d.z >= t.l AND d.z < t.r GROUP BY t.l, t.r) SELECT round(l, 6) AS \"left\", round(r, 6) AS \"right\", area FROM a")
def _(spark, sf):
    d = change(spark, sf)
    return hypso.hypsometry_area(hypso.hypsometric_binning(d, 8, "count"), d, 400.0).select(*r6("left", "right"), "area")


_AREA_MEAN = (
    _COUNT
    + """, k AS (SELECT (l + r) / 2 AS m, value, row_number() OVER (ORDER BY l) AS i, count(*) OVER () AS n FROM t WHERE value IS NOT NULL),
g AS (SELECT m AS a, lead(m) OVER (ORDER BY i) AS b, value AS va, lead(value) OVER (ORDER BY i) AS vb, i, n FROM k),
h AS (SELECT d.z - (va + (d.z - a) * (vb - va) / (b - a)) / 2 AS z FROM d JOIN g ON b IS NOT NULL AND (d.z > a OR i = 1) AND (d.z <= b OR i = n - 1)),
o AS (SELECT l, r, bin = max(bin) OVER () AS last FROM t)
SELECT round(o.l, 6) AS "left", round(o.r, 6) AS "right", count(h.z) * 400.0 AS area FROM o LEFT JOIN h ON h.z >= o.l AND (h.z < o.r OR (o.last AND h.z = o.r)) GROUP BY o.l, o.r"""
)


@query("hypso_area_mean", _AREA_MEAN)
def _(spark, sf):
    d = change(spark, sf)
    bins = hypso.interpolate_bins(hypso.hypsometric_binning(d, 8, "count"))
    return hypso.hypsometry_area(bins, d, 400.0, "mean").select(*r6("left", "right"), "area")


@query("hypso_interpolate")
def _(spark, sf):
    return hypso.interpolate_bins(hypso.hypsometric_binning(change(spark, sf), 5.0), count_threshold=30).select(*r6("left", "right", "value"), "count")


_NARROW = _FIXED.replace("10.0 * k", "5.0 * k").replace("hi - lo + 10 + 1e-6) / 10)", "hi - lo + 5 + 1e-6) / 5)")
_KNOTS = _NARROW + ", m AS (SELECT l, r, (l + r) / 2 AS m, n, {value} FROM t)"


@query(
    "hypso_interpolate_linear",
    _KNOTS.replace("{value}", "CASE WHEN n >= 30 THEN value END AS v")
    + """, k AS (SELECT m, v FROM m WHERE v IS NOT NULL),
f AS (SELECT m.l, m.r, m.m, m.n, m.v, arg_max(k.v, k.m) FILTER (WHERE k.m <= m.m) AS p, max(k.m) FILTER (WHERE k.m <= m.m) AS pm, arg_min(k.v, k.m) FILTER (WHERE k.m > m.m) AS q, min(k.m) FILTER (WHERE k.m > m.m) AS qm FROM m, k GROUP BY m.l, m.r, m.m, m.n, m.v)
SELECT round(l, 6) AS "left", round(r, 6) AS "right", round(coalesce(v, CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN p ELSE p + (q - p) * (m - pm) / (qm - pm) END), 6) AS value, n AS count FROM f""",
)
def _(spark, sf):
    return hypso.interpolate_bins(hypso.hypsometric_binning(change(spark, sf), 5.0), "linear", 30).select(*r6("left", "right", "value"), "count")


_BIN = ["l", "r", "n", "v", "u", "ok"]


def _refit(name: str, source: str) -> str:
    """A cubic fit of the bins that are ok, and after it which of them lie within three deviations of all of its values."""
    cubic = fitted(f"{name}_fit", source, _BIN, [f"power(u, {k})" for k in range(4)], "v", "ok")
    near = f"abs(f - v) <= 3 * (SELECT stddev_pop(f - v) FROM {name}_fit)"
    return f", {cubic}, {name} AS (SELECT l, r, n, v, u, f, ok AND {near} AS ok FROM {name}_fit)"


_CUBIC = (
    _KNOTS.replace("{value}", "CASE WHEN n >= 10 THEN value END AS v")
    + ", a AS (SELECT l, r, n, v, (m - (SELECT avg(m) FROM m)) / (SELECT stddev_pop(m) FROM m) AS u, v IS NOT NULL AS ok FROM m)"
    + _refit("once", "a")
    + _refit("twice", "once")
    + _refit("thrice", "twice")
    + ' SELECT round(l, 6) AS "left", round(r, 6) AS "right", round(f, 6) AS value, n AS count FROM thrice'
)


@query("hypso_polynomial", _CUBIC)
def _(spark, sf):
    return hypso.fit_bins(hypso.hypsometric_binning(change(spark, sf), 5.0), 3, 3, 10).select(*r6("left", "right", "value"), "count")


_FILL = (
    _FIXED
    + """, k AS (SELECT (l + r) / 2 AS m, value FROM t WHERE value IS NOT NULL),
f AS (SELECT d.row, d.col, d.dh, d.z, arg_max(k.value, k.m) FILTER (WHERE k.m <= d.z) AS p, max(k.m) FILTER (WHERE k.m <= d.z) AS pm, arg_min(k.value, k.m) FILTER (WHERE k.m > d.z) AS q, min(k.m) FILTER (WHERE k.m > d.z) AS qm FROM d CROSS JOIN k GROUP BY d.row, d.col, d.dh, d.z)
SELECT row, col, round(coalesce(dh, CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN p ELSE p + (q - p) * (z - pm) / (qm - pm) END), 6) AS dh FROM f"""
)


@query("hypso_fill", _FILL)
def _(spark, sf):
    return hypso.fill_hypsometric(change(spark, sf), 10.0).select("row", "col", *r6("dh"))


_LOCAL = (
    _D
    + """, s AS (SELECT zone, min(z) AS lo, max(z) AS hi, avg(CASE WHEN dh IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM d WHERE zone > 0 GROUP BY zone),
c AS (SELECT d.*, lo, (hi - lo) / 6.0 AS w, CAST(least(5, floor((z - lo) / ((hi - lo) / 6.0))) AS INTEGER) AS bin FROM d LEFT JOIN s ON d.zone = s.zone AND share >= 0.2),
m AS (SELECT zone, bin, median(dh) AS m FROM c WHERE dh IS NOT NULL AND bin IS NOT NULL GROUP BY zone, bin),
n AS (SELECT c.row, c.col, c.dh, (c.z - lo) / w - 0.5 AS x, c.zone FROM c),
f AS (SELECT n.row, n.col, n.dh, x, arg_max(m.m, m.bin) FILTER (WHERE m.bin <= x) AS p, max(m.bin) FILTER (WHERE m.bin <= x) AS pb, arg_min(m.m, m.bin) FILTER (WHERE m.bin > x) AS q, min(m.bin) FILTER (WHERE m.bin > x) AS qb FROM n LEFT JOIN m ON n.zone = m.zone GROUP BY n.row, n.col, n.dh, x)
SELECT row, col, round(coalesce(dh, CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN p ELSE p + (q - p) * (x - pb) / (qb - pb) END), 6) AS dh FROM f"""
)


@query("hypso_fill_local", _LOCAL)
def _(spark, sf):
    return hypso.fill_local_hypsometric(change(spark, sf), 6).select("row", "col", *r6("dh"))


_REGION = (
    _D
    + """, s AS (SELECT zone, min(z) AS lo, max(z) AS hi FROM d WHERE zone > 0 GROUP BY zone),
v AS (SELECT d.zone, CAST(least(9, floor((z - lo) / (hi - lo) * 10)) AS INTEGER) AS bin, avg(dh) AS v, count(*) AS k FROM d JOIN s ON d.zone = s.zone WHERE dh IS NOT NULL GROUP BY 1, 2),
e AS (SELECT zone, min(v) AS a, max(v) AS b FROM v GROUP BY zone), n AS (SELECT bin, (v - a) / (b - a) AS s, k FROM v JOIN e USING (zone))
SELECT bin, round(sum(s * k) / sum(k), 6) AS w_mean, round(stddev_pop(s), 6) AS std, CAST(sum(k) AS BIGINT) AS count, round(median(s), 6) AS median, round(quantile_cont(s, 0.8413), 6) AS sigma_upper FROM n GROUP BY bin"""
)


@query("regional_signal", _REGION)
def _(spark, sf):
    return hypso.regional_signal(change(spark, sf), 10).select("bin", *r6("w_mean", "std"), "count", *r6("median", "sigma_upper"))


_REGION_FILL = (
    _D
    + """, s AS (SELECT zone, min(z) AS lo, max(z) AS hi FROM d WHERE zone > 0 GROUP BY zone),
v AS (SELECT d.zone, CAST(least(9, floor((z - lo) / (hi - lo) * 10)) AS INTEGER) AS bin, avg(dh) AS v, count(*) AS k FROM d JOIN s ON d.zone = s.zone WHERE dh IS NOT NULL GROUP BY 1, 2),
e AS (SELECT zone, min(v) AS a, max(v) AS b FROM v GROUP BY zone), n AS (SELECT bin, (v - a) / (b - a) AS s, k FROM v JOIN e USING (zone)),
g AS (SELECT bin, sum(s * k) / sum(k) AS w FROM n GROUP BY bin),
c AS (SELECT d.row, d.col, d.zone, d.dh, CASE WHEN s.zone IS NOT NULL THEN CAST(least(9, floor((z - lo) / (hi - lo) * 10)) AS INTEGER) END AS bin FROM d LEFT JOIN s ON d.zone = s.zone),
m AS (SELECT c.row, c.col, c.zone, c.dh, g.w FROM c LEFT JOIN g ON c.bin = g.bin),
f AS (SELECT zone, regr_slope(dh, w) AS slope, regr_intercept(dh, w) AS level FROM m WHERE dh IS NOT NULL AND w IS NOT NULL GROUP BY zone)
SELECT m.row, m.col, round(coalesce(dh, slope * w + level), 6) AS dh FROM m LEFT JOIN f ON m.zone = f.zone"""
)


@query("regional_fill", _REGION_FILL)
def _(spark, sf):
    return hypso.fill_regional(change(spark, sf), n_bins=10).select("row", "col", *r6("dh"))


@query("idw_fill", _D + " SELECT a.row, a.col, round(coalesce(a.dh, sum(b.dh / sqrt(power(a.row - b.row, 2) + power(a.col - b.col, 2))) / sum(1 / sqrt(power(a.row - b.row, 2) + power(a.col - b.col, 2)))), 6) AS dh FROM d a LEFT JOIN d b ON a.dh IS NULL AND b.dh IS NOT NULL AND b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 AND power(a.row - b.row, 2) + power(a.col - b.col, 2) <= 9 GROUP BY a.row, a.col, a.dh")
def _(spark, sf):
    return hypso.fill_idw(change(spark, sf), 3).select("row", "col", *r6("dh"))


REFERENCE = datetime(1995, 1, 1)
_T = "TIMESTAMP '1995-01-01'"
_DD = f"WITH s AS ({SERIES}), r AS (SELECT * FROM s WHERE ts = {_T}), d AS (SELECT least(s.ts, {_T}) AS start_ts, greatest(s.ts, {_T}) AS end_ts, s.row, s.col, r.z - s.z AS dh FROM s JOIN r ON s.row = r.row AND s.col = r.col WHERE s.ts <> {_T})"


@query("dh_epochs", _DD + " SELECT epoch(start_ts) AS start_s, epoch(end_ts) AS end_s, row, col, round(dh, 6) AS dh FROM d")
def _(spark, sf):
    d = series.subtract_epochs(tables.series(spark, sf), REFERENCE)
    return d.select(F.unix_timestamp("start_ts").cast("double").alias("start_s"), F.unix_timestamp("end_ts").cast("double").alias("end_s"), "row", "col", *r6("dh"))


def _collection(spark, sf):
    outlines = tables.sparse(spark, sf).select("row", (F.col("col") % 13).alias("col"), F.lit("A").alias("name"))
    return series.Collection(tables.series(spark, sf), REFERENCE, 400.0, outlines)


@query("dh_series", _DD + " SELECT year(start_ts) AS y0, year(end_ts) AS y1, round(avg(dh), 6) AS dh, count(*) * 400.0 AS area FROM d GROUP BY 1, 2")
def _(spark, sf):
    s = series.dh_series(series.subtract_epochs(tables.series(spark, sf), REFERENCE), 400.0)
    return s.select(F.year("start_ts").cast("long").alias("y0"), F.year("end_ts").cast("long").alias("y1"), *r6("dh"), "area")


@query("dv_series_masked", _DD + f", m AS (SELECT DISTINCT CAST(floor(l_partkey / 20) AS INTEGER) AS row, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 30) AS INTEGER) % 13 AS col FROM lineitem) SELECT year(start_ts) AS y0, year(end_ts) AS y1, round(avg(dh) * count(*) * 400.0, 4) AS dv FROM d SEMI JOIN m USING (row, col) GROUP BY 1, 2")
def _(spark, sf):
    s = _collection(spark, sf).dv("name = 'A'")
    return s.select(F.year("start_ts").cast("long").alias("y0"), F.year("end_ts").cast("long").alias("y1"), F.round("dv", 4).alias("dv"))


@query("cum_series", _DD + f", s2 AS (SELECT CASE WHEN start_ts = {_T} THEN end_ts ELSE start_ts END AS ts, -avg(dh) AS v FROM d GROUP BY start_ts, end_ts UNION ALL SELECT {_T}, 0) SELECT year(ts) AS y, round(v - first_value(v) OVER (ORDER BY ts), 6) AS dh FROM s2")
def _(spark, sf):
    s = series.Collection(tables.series(spark, sf), REFERENCE, 400.0).cumulative()
    return s.select(F.year("ts").cast("long").alias("y"), *r6("dh"))
