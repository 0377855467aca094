"""Steps that must stay bounded, or whole, on larger tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.grid import Grid, from_array, to_array
from talus.operators import align, biascorr, fitting, geostat, resample
from talus.queries import geostatistics

GRID = Grid(transform=(10.0, 0.0, 1000.0, 0.0, -10.0, 5000.0))


def test_simplex_search_takes_few_jobs(spark):
    """The search leaves its first window, and still sends no job for each of its steps."""
    r, c = np.meshgrid(np.arange(30), np.arange(30), indexing="ij")
    f = lambda r, c: 20 * np.sin(r / 5) + 15 * np.cos(c / 4)
    ref, tba = from_array(spark, f(r, c)), from_array(spark, f(r - 3.2, c + 1.5) - 2.0)
    spark.sparkContext.setJobGroup("simplex", "simplex")
    try:
        fit = align.DhMinimize(tolerance=0.05).fit(ref, tba, GRID)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("simplex"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    east, north = (v / 10 for v in fit.translations[:2])
    assert (east, north) == pytest.approx((1.5, 3.2), abs=0.3)
    assert max(abs(east), abs(north)) > align.REACH
    assert jobs < 60
    # what it reports is what the distributed step finds there
    dh = np.array([x.dh for x in align._dh(align.prepare(ref, None, 1, 42), tba, east, north).collect()])
    assert fit.report["loss"] == pytest.approx(1.4826 * np.median(np.abs(dh - np.median(dh))), rel=1e-9)
    assert fit.report["shift_z"] == pytest.approx(np.median(dh), rel=1e-9) and math.isfinite(fit.report["shift_z"])


def test_all_pairs_of_any_number_of_points(spark, monkeypatch):
    """More points than one side of a broadcast may have, and the same value as by the broadcast."""
    monkeypatch.setattr(geostat, "BLOCK", 37)
    monkeypatch.setattr(geostat, "CHUNK", 11)
    params = [{"model": "spherical", "range": 60.0, "psill": 0.7}, {"model": "exponential", "range": 300.0, "psill": 0.3}]
    points = spark.range(150).select(F.col("id").alias("pid"), (F.col("id") % 13 * 10.0).alias("x"), (F.col("id") * 7.0 % 90).alias("y"), (1 + F.col("id") % 5 / 10.0).alias("err"))
    assert geostat.neff_all_pairs(points, params) == pytest.approx(geostat.neff_exact(points, params), rel=1e-12)
    monkeypatch.setattr(geostat, "MOST", 100)
    assert geostat.neff_all_pairs(points, params) > 0
    # the query takes the way without a bound
    monkeypatch.setattr(geostat, "neff_exact", None)
    assert geostatistics.QUERIES["neff_exact"](spark, "/root/testdata/sf0.001").count() == 1


def test_genton_by_blocks_finds_the_rank(spark, monkeypatch):
    """Small blocks, cells and lists, so that all passes take part; ties and outliers; in few jobs."""
    for name, v in {"_CELLS": 64, "_BLOCK": 50, "_BUCKETS": 16, "_LISTED": 300, "_ONCE": 100}.items():
        monkeypatch.setattr(geostat, name, v)
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=400), 1: np.append(rng.normal(size=300), [1e6, -1e9]), 2: np.round(rng.normal(size=350), 1), 3: np.repeat([1.0, 2.0], [90, 10]), 4: rng.integers(0, 4, 200).astype(float)}
    rows = [(g, float(v), abs(float(v))) for g, vs in groups.items() for v in vs]
    spark.sparkContext.setJobGroup("genton", "genton")
    try:
        got = {r.run: r.exp for r in geostat._estimate(spark.createDataFrame(rows, "run int, signed double, d double"), ["run"], "genton").collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("genton"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    for g, v in groups.items():
        d = np.sort(np.abs(v[:, None] - v)[np.triu_indices(len(v), 1)])
        h = len(v) // 2 + 1
        assert got[g] == pytest.approx(0.5 * (2.219 * d[h * (h - 1) // 2 - 1]) ** 2, rel=1e-9, abs=1e-18)
    assert jobs < 40


def test_fits_of_all_orders_share_their_passes(spark):
    """As many passes as for one order, and the coefficients of each order fitted alone."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, 400)
    y = 1 + 2 * x - x**3 + rng.normal(0, 0.1, 400) + (rng.random(400) < 0.1) * 5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").persist()
    powers = [F.pow("x", F.lit(k)) if k else F.lit(1.0) for k in range(5)]
    spark.sparkContext.setJobGroup("orders", "orders")
    try:
        fits = fitting.nested_fits(df, powers, F.col("y"), [2, 3, 4, 5], True)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("orders"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    for k, c in zip((2, 3, 4, 5), fits, strict=True):
        assert c == pytest.approx(fitting.linear_fit(df, powers[:k], F.col("y"), True), rel=1e-9, abs=1e-12)
    assert jobs <= 4 * (1 + 2 * 8)


def test_bias_by_bins_reads_its_differences_once(spark, monkeypatch):
    seen = []
    real = biascorr.quantiles
    monkeypatch.setattr(biascorr, "quantiles", lambda df, *a: seen.append("InMemory" in df._jdf.queryExecution().executedPlan().toString()) or real(df, *a))
    z = np.add.outer(np.arange(12.0) ** 2, np.arange(12.0))
    biascorr.TerrainBias("slope", bins=3).fit(from_array(spark, z), from_array(spark, z - 1), GRID)
    assert seen == [True]


def test_bounded_search_sends_points_once(spark):
    """Points aren't copied to the cells around them; ties go to the least oid; points without any in reach are left out."""
    rng = np.random.default_rng(8)
    a, b = np.round(rng.uniform(-90, 90, (150, 3))), np.round(rng.uniform(-90, 90, (150, 3)))
    a = np.append(a, [[9e3, 0, 0], [0.5, 0.5, 0.0]], axis=0)
    b = np.append(b, [[0.0, 0.5, 0.0], [1.0, 0.5, 0.0]], axis=0)
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(a)], "pid long, x double, y double, z double")
    others = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(b)], "oid long, ox double, oy double, oz double")
    found = align.nearest(points, others, 10.0, reach=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan
    got = {r.pid: (r.oid, r.d2) for r in found.collect()}
    for k, p in enumerate(a):
        near = [o for o, q in enumerate(b) if all(abs(math.floor(p[c] / 10) - math.floor(q[c] / 10)) <= 1 for c in (0, 1))]
        d2 = {o: ((p - b[o]) ** 2).sum() for o in near}
        assert got.get(k) == (min((v, o) for o, v in d2.items())[::-1] if near else None)


def test_kept_others_are_not_dealt_again(spark):
    """The same partners as by nearest(), near and far, while the others stay where they are."""
    rng = np.random.default_rng(9)
    a, b = np.append(rng.uniform(0, 40, (60, 3)), [[500.0, -300.0, 0.0]], axis=0), rng.uniform(0, 40, (80, 3))
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(a)], "pid long, x double, y double, z double")
    others = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(b)], "oid long, ox double, oy double, oz double")
    kept = align._Kept(others, 4.0)
    try:
        want = np.argmin(((a[:, None] - b[None]) ** 2).sum(axis=2), axis=1)
        assert {r.pid: r.oid for r in kept.nearest(points).collect()} == dict(enumerate(want.tolist()))
        near = points.where("pid < 60")
        assert {r.pid: r.oid for r in kept.nearest(near).collect()} == dict(enumerate(want[:60].tolist()))
    finally:
        kept.release()


def test_rotations_deal_the_raster_once(spark, monkeypatch):
    """Tiles give what a join for each step gives, at rims and voids too; rotations that drift too far take the joins."""
    rng = np.random.default_rng(6)
    z = rng.normal(50, 20, (40, 30))
    z[rng.random(z.shape) < 0.05] = np.nan
    m, centre = resample.matrix(5.0, -7.0, 1.0, 0.5, -0.4, 3.0), (1150.0, 4800.0, 10.0)
    monkeypatch.setattr(resample, "TILE", 16)
    tiled = resample.apply_to_raster(from_array(spark, z), GRID, m, centre, iterations=3)[0]
    assert "Join" not in tiled._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(resample, "DRIFT", -1)
    joined = resample.apply_to_raster(from_array(spark, z), GRID, m, centre, iterations=3)[0]
    got, want = to_array(tiled, 40, 30), to_array(joined, 40, 30)
    assert np.isfinite(want).sum() > 300
    assert np.array_equal(np.isnan(got), np.isnan(want))
    assert np.nanmax(np.abs(got - want)) < 1e-9
