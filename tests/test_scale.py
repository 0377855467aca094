"""Plans and values of operators that must not lean on one task, a cross join or reused exchanges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talus.operators import geostat, masks, stats, terrain


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_quantiles_do_not_depend_on_exchanges(spark, reuse, adaptive):
    rng = np.random.default_rng(5)
    zone = np.repeat(np.arange(40), np.arange(1, 41) ** 2 // 2 + 1)
    frame = pd.DataFrame({"zone": zone, "v": np.where(rng.random(len(zone)) < 0.5, rng.lognormal(0, 3, len(zone)), np.round(rng.normal(size=len(zone)), 1))})
    probs = {"a": 0.0, "b": 0.05, "m": 0.5, "c": 0.9, "d": 0.999, "e": 1.0}
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        df = spark.createDataFrame(frame).repartition(5)
        got = {r.zone: r for r in stats.quantiles(df, ["zone"], "v", probs).collect()}
        whole = stats.quantiles(df, [], "v", probs).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for z, g in frame.groupby("zone"):
        assert [got[z][k] for k in probs] == pytest.approx([np.quantile(g.v, p) for p in probs.values()], rel=1e-9, abs=1e-12)
        assert got[z].n == len(g)
    assert [whole[k] for k in probs] == pytest.approx([np.quantile(frame.v, p) for p in probs.values()], rel=1e-9)


def test_quantiles_of_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (1, 2.0), (2, None), (None, 5.0)], "zone int, v double")
    got = {r.zone: (r.n, r.m) for r in stats.quantiles(df, ["zone"], "v", {"m": 0.5}).collect()}
    assert got == {1: (2, 2.0), None: (1, 5.0)}
    assert stats.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_lookup_by_bins_is_an_equal_join(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(size=400), "b": rng.integers(0, 9, 400).astype(float), "v": rng.normal(size=400)})
    frame.loc[:5, "a"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, v double")
    bins = stats.nd_binning(df, "v", {"a": [-2.0, -0.3, 0.1, 3.0], "b": [0.0, 3.0, 8.0]})
    got = stats.perbin_lookup(df, bins, ["a", "b"], "nanmedian", 5)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    table = [(r.a.left, r.a.right, r.b.left, r.b.right, r.nanmedian) for r in bins.where("nd = 2 and count > 5").collect()]
    for r in got.collect():
        want = [m for al, ar, bl, br, m in table if r.a is not None and al <= r.a < ar and bl <= r.b < br]
        assert r.nanmedian == (want[0] if want else None)
    overlapping = spark.sql("select 1 nd, 9 count, struct(x * 1.0d as left, x + 2.0d as right) a, 0d nanmedian from values (0), (1) t(x)")
    with pytest.raises(ValueError):
        stats.perbin_lookup(df, overlapping, ["a"])


def test_samples_are_thinned_before_they_are_sorted(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    want = sorted(r.k for r in df.orderBy(F.xxhash64("k", F.lit(42)), "k").limit(300).collect())
    got = masks.sample(df, 300, keys=["k"])
    assert sorted(r.k for r in got.collect()) == want
    assert "Filter" in plan(got)
    assert masks.sample(df, 50_000, keys=["k"]).count() == 20_000


def test_all_pairs_need_a_bound(spark):
    points = spark.range(30_000).select(F.col("id").alias("pid"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("err"))
    params = [{"model": "spherical", "range": 10.0, "psill": 1.0}]
    with pytest.raises(ValueError):
        geostat.neff_exact(points, params)
    few = points.where("pid < 300")
    assert geostat.number_effective_samples(few, params, 100) == pytest.approx(geostat.neff_exact(few, params, 100))


def test_effective_samples_of_models_without_closed_form(spark):
    closed = [{"model": "exponential", "range": 30.0, "psill": 2.0}]
    stable = [{"model": "stable", "range": 30.0, "psill": 2.0, "smooth": 1.0}]
    for area in (10.0, 900.0, 1e5):
        assert geostat.number_effective_samples(area, stable) == pytest.approx(float(geostat.neff_circular(area, closed)), rel=1e-4)
    square = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)]
    assert geostat.number_effective_samples(square, closed) == pytest.approx(float(geostat.neff_circular(900.0, closed)))
    cells = spark.range(50).select((F.col("id") % 3).alias("zone"), F.lit(2.0).alias("sigma"))
    got = {r.zone: r for r in geostat.propagate(cells, stable, 9.0).collect()}
    want = {r.zone: r for r in geostat.propagate(cells, closed, 9.0).collect()}
    assert all(got[z].standard_error == pytest.approx(want[z].standard_error, rel=1e-4) for z in want)
    matern = [{"model": "matern", "range": 30.0, "psill": 2.0, "smooth": 1.5}]
    assert all(0 < r.standard_error <= 2.0 for r in geostat.propagate(cells, matern, 9.0).collect())


def test_circular_means_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    cells = [(i, j, None if rng.random() < 0.2 else float(rng.normal())) for i in range(20) for j in range(23) if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "row int, col int, z double")
    z = {(i, j): v for i, j, v in cells if v is not None}
    for size in (3, 4, 7):
        r, c = size // 2, (size - 1) / 2
        kernel = [(i - r, j - r) for i in range(size) for j in range(size) if (i - c) ** 2 + (j - c) ** 2 < (size / 2) ** 2]
        for g in terrain.mean_filter(df, size).collect():
            met = [z[g.row + i, g.col + j] for i, j in kernel if (g.row + i, g.col + j) in z]
            assert (g.n, g.kernel_size) == (len(met), len(kernel))
            assert (g.mean is None) if not met else math.isclose(g.mean, sum(met) / len(met), abs_tol=1e-9)


def test_texture_shading_has_a_stated_bound(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (100, 100, 2.0)], "row int, col int, z double")
    with pytest.raises(ValueError):
        terrain.texture_shading(df, most=1000)


def test_texture_shading_is_not_one_group(spark):
    small, large = (spark.range(n).selectExpr("int(id div 64) row", "int(id % 64) col", "hash(id) / 1e6 z") for n in (6400, 640_000))
    assert "_all" in plan(terrain.texture_shading(small)) and "_all" not in plan(terrain.texture_shading(large))
    void = terrain.texture_shading(large.withColumn("z", F.expr("double(null)")))
    assert "_all" not in plan(void) and void.agg(F.count("*"), F.count("texture_shading")).first() == (640_000, 0)


@pytest.mark.parametrize(("height", "width", "alpha", "block"), [(90, 41, 0.8, 512), (41, 90, 0.0, 512), (1030, 3, 2.0, 64), (1, 1100, 0.8, 64), (300, 290, 1.3, 40)])
def test_texture_shading_by_blocks_equals_the_whole(spark, height, width, alpha, block):
    rng = np.random.default_rng(height)
    z = 1000 + 50 * rng.normal(size=(height, width))
    z[rng.random(z.shape) < 0.1] = np.nan
    z[height // 3 : height // 2] = np.nan
    z[0, 0] = z[-1, -1] = 990.0
    # cells without a height are in the table or, in a part of the lines, are not
    there = ~np.isnan(z) | (np.arange(height) < 0.4 * height)[:, None]
    rows, cols = np.nonzero(there)
    pdf = pd.DataFrame({"row": rows - 7, "col": cols + 5, "z": z[rows, cols]})
    df = spark.createDataFrame(pdf, "row int, col int, z double")
    made = terrain.texture_shading(df, alpha, block=block)
    assert "_all" not in plan(made) and made.dtypes == [("row", "int"), ("col", "int"), ("texture_shading", "double")]
    got = made.orderBy("row", "col").toPandas()
    assert got["row"].tolist() == pdf["row"].tolist() and got["col"].tolist() == pdf["col"].tolist()
    np.testing.assert_allclose(got["texture_shading"].to_numpy(float), terrain.texture_array(z, alpha)[rows, cols], rtol=0, atol=1e-9)
