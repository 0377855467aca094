import warnings
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talus import workflows
from talus.api import PointCloud, Raster
from talus.grid import Grid, from_array, from_nested, to_array
from talus.operators import align, geostat, hypso, masks, series, stats, vertical
from talus.sources import files
from talus.streaming import surface


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=301), np.zeros(200)])
    g = rng.integers(0, 3, len(v))
    rows = [(int(a), float(b)) for a, b in zip(g, v, strict=True)] + [(0, None), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    got = {r.g: r for r in stats.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).collect()}
    assert set(got) == {0, 1, 2}
    for k in got:
        assert [got[k][c] for c in "abcd"] == pytest.approx(list(np.quantile(v[g == k], [0, 0.37, 0.5, 1])))
    assert stats.nmad(df, "v").first()["nmad"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
    assert stats.quantiles(df.limit(0), [], "v", {"a": 0.5}).count() == 0


def test_bins(spark):
    edges = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4]
    xs = [-0.1, 0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.4, 0.41, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.b for r in df.select(stats.bin_index(F.col("x"), edges).alias("b")).collect()]
    assert got == [None, 0, 1, 2, 2, 3, 3, None, None]
    assert stats.parse_interval("[1.5, 2)") == (1.5, 2.0)
    with pytest.raises(ValueError):
        stats.parse_interval("none")
    grid = pd.DataFrame([{"nd": 2, "a": {"left": i, "right": i + 1}, "b": {"left": j, "right": j + 1}, "count": 100, "nmad": i + 10 * j} for i in range(3) for j in range(3)])
    f = stats.BinInterpolator(grid, ["a", "b"])
    assert f(np.array([0.5, 1.0, 9.0]), np.array([0.5, 1.0, 9.0])) == pytest.approx([0, 5.5, 22])
    points = spark.createDataFrame([(1.0, 1.0), (0.5, 2.5)], "a double, b double")
    assert [r.e for r in points.select(f.column().alias("e")).collect()] == pytest.approx([5.5, 20])


def test_hypsometry(spark):
    rows = [(k, 0, float(z), None if k % 10 == 3 else float(z) / 10) for k, z in enumerate(np.linspace(0, 99.9, 300))]
    df = spark.createDataFrame(rows, "row int, col int, z double, dh double")
    t = hypso.hypsometric_binning(df, [0.0, 25.0, 50.0, 100.0], "custom").orderBy("bin").toPandas()
    assert t["value"].to_numpy() == pytest.approx([1.25, 3.75, 7.5], abs=0.06)  # each bin's own value stands in its row
    filled = hypso.fill_hypsometric(df, 10.0)
    assert filled.where("dh is null").isEmpty()
    assert filled.select(F.max(F.abs(F.col("dh") - F.col("z") / 10))).first()[0] < 0.6
    area = hypso.hypsometry_area(hypso.hypsometric_binning(df, 10.0), df, 4.0)
    assert area.agg(F.sum("area")).first()[0] == 1200.0
    with pytest.raises(ValueError):
        hypso.hypsometry_area(hypso.hypsometric_binning(df, 10.0), df, 4.0, "later")
    idw = hypso.fill_idw(df, 2)
    assert idw.where("dh is null").isEmpty()
    zoned = df.withColumn("zone", F.col("row") % 3)
    assert hypso.fill_local_hypsometric(zoned, 10).where("dh is null and zone > 0").isEmpty()
    assert hypso.fill_regional(zoned, n_bins=10).where("dh is null and zone > 0").isEmpty()
    assert hypso.fit_bins(hypso.hypsometric_binning(df, 10.0), 1).select(F.max(F.abs(F.col("value") - (F.col("left") + F.col("right")) / 20))).first()[0] < 0.2


def test_series(spark):
    t = [datetime(1990, 8, 1), datetime(2009, 8, 1), datetime(2060, 8, 1)]
    rows = [(t[k], i, j, 100.0 - 10 * k + i) for k in (2, 0, 1) for i in range(3) for j in range(2)]
    long = spark.createDataFrame(rows, "ts timestamp, row int, col int, z double")
    c = series.Collection(long, t[1], 25.0)
    assert c.timestamps() == t
    dh = {(r.start_ts, r.end_ts): (r.dh, r.area) for r in c.dh().collect()}
    assert dh == {(t[0], t[1]): (-10.0, 150.0), (t[1], t[2]): (10.0, 150.0)}
    assert [(r.ts, r.dh) for r in c.cumulative().orderBy("ts").collect()] == [(t[0], 0.0), (t[1], -10.0), (t[2], -20.0)]
    holes = series.Collection(long.withColumn("z", F.when(F.col("row") > 0, F.col("z"))), t[1])
    with pytest.raises(ValueError):
        holes.dh()
    assert holes.dh(missing_ok=True).count() == 2
    d = series.DDem(series.subtract_epochs(holes.df, t[1]).where(F.col("end_ts") == t[2]).select("row", "col", "dh"), t[1], t[2])
    assert d.filled() is None and d.interpolate("idw", radius=2).filled() is not None and d.time.days == 18628
    with pytest.raises(NotImplementedError):
        d.interpolate("linear")


def test_variograms_and_models(spark):
    models = [{"model": "sph", "range": 10.0, "psill": 0.7}, {"model": "gaussian", "range": 100.0, "psill": 0.3}]
    h = np.linspace(1, 200, 300)
    noisy = geostat.gamma(models, h) + np.random.default_rng(42).normal(0, 0.01, 300)
    fitted = geostat.fit_models(["spherical", "gaussian"], pd.DataFrame({"lags": h, "exp": noisy, "err_exp": np.nan}))
    for m, f in zip(models, fitted, strict=True):
        assert f["range"] == pytest.approx(m["range"], rel=0.3) and f["psill"] == pytest.approx(m["psill"], rel=0.3)
    assert geostat.covariance(models, np.array([0.0])) == pytest.approx([1.0]) and geostat.correlation(models, np.array([1e6])) == pytest.approx([0.0], abs=1e-9)
    for area in (100.0, 1e4, 1e6):
        for name in ("spherical", "exponential", "gaussian", "cubic"):
            one = [{"model": name, "range": 50.0, "psill": 2.0}]
            assert float(geostat.neff_circular(area, one)) == pytest.approx(geostat.neff_numerical(area, one), rel=1e-3)
    for bad in ([{"model": "x", "range": 1, "psill": 1}], [{"model": "sph", "range": -1, "psill": 1}], [{"model": "sph"}]):
        with pytest.raises(ValueError):
            geostat.check_models(bad)
    rng = np.random.default_rng(7)
    x, y, z = rng.uniform(0, 100, 150), rng.uniform(0, 100, 150), rng.normal(size=150)
    points = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, z, strict=True))], "pid long, x double, y double, z double")
    d, dz = np.hypot(x[:, None] - x, y[:, None] - y)[np.triu_indices(150, 1)], np.abs(z[:, None] - z)[np.triu_indices(150, 1)]
    got = {r.lags: (r.exp, r["count"]) for r in geostat.variogram(points, [20.0, 50.0, 150.0], "matheron").collect()}
    for lo, hi in ((0, 20), (20, 50)):
        sel = (d > lo) & (d <= hi)
        assert got[float(hi)] == (pytest.approx((dz[sel] ** 2).mean() / 2), sel.sum())
    assert set(got) == {20.0, 50.0}
    for e in geostat.ESTIMATORS:
        v = geostat.variogram(points, [20.0, 50.0, 150.0], e).toPandas()
        assert v["exp"].between(0.5, 2).all()
    v = geostat.variogram(points, [20.0, 50.0, 100.0, 150.0], "dowd", 400, "cdist_equidistant", runs=3).toPandas()
    assert len(v) == 3 and v["exp"].between(0.2, 5).all()


def test_effective_samples_and_patches(spark):
    pts = spark.createDataFrame([(i * 15 + j, float(i), float(j), 1.0) for i in range(15) for j in range(15)], "pid long, x double, y double, err double")
    m = [{"model": "spherical", "range": 3.0, "psill": 1.0}]
    assert geostat.neff_exact(pts, m, 100) == pytest.approx(geostat.neff_exact(pts, m), rel=0.1)
    rng = np.random.default_rng(1)
    t = geostat.patches_method(from_array(spark, rng.normal(size=(40, 40))), [9.0, 25.0])
    assert t["nmad"].tolist() == pytest.approx([1 / 3, 1 / 5], abs=0.12) and t["nb_indep_patches"].tolist() == [144, 49]


def test_masks(spark):
    z = from_array(spark, np.arange(25.0).reshape(5, 5))
    assert masks.sample(z, 7).count() == 7
    assert {tuple(r) for r in masks.sample(z, 7).collect()} == {tuple(r) for r in masks.sample(z.repartition(4), 7).collect()}
    assert masks.set_mask(z, z.where("row = 1")).where("z is null").count() == 5
    d = {(r.row, r.col): r.distance for r in masks.proximity(z, z.where("row = 0 and col = 0"), 2).collect()}
    assert d[0, 0] == 0 and d[1, 1] == pytest.approx(2**0.5) and d[3, 0] is None


def test_vertical_references(spark):
    assert [vertical.parse(v) for v in ("egm96", 3855, "EPSG:5773", "ellipsoid", "x.tif")] == ["EGM96", "EGM08", "EGM96", "Ellipsoid", "x.tif"]
    for bad in (1, "other"):
        with pytest.raises(ValueError):
            vertical.parse(bad)
    grid = Grid(vcrs="EGM96", area_or_point="Point")
    z = Raster(from_array(spark, np.full((3, 3), 10.0)), grid)
    geoid = (from_array(spark, np.full((3, 3), 7.0)), grid)
    up = z.to_vcrs("Ellipsoid", {"EGM96": geoid})
    assert up.grid.vcrs == "Ellipsoid" and np.allclose(up.to_array(3, 3), 17.0)
    with pytest.raises(ValueError):
        z.to_vcrs("EGM08", {"EGM96": geoid})
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert np.allclose(z.to_vcrs("EGM96", {}).to_array(3, 3), 10.0) and w


def test_objects_and_files(spark, tmp_path):
    grid = Grid(transform=(5.0, 0.0, 100.0, 0.0, -5.0, 200.0))
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 7))
    a[2, 3] = np.nan
    r = Raster.from_array(spark, np.where(np.isnan(a), -9999, a), grid, nodata=-9999)
    np.testing.assert_allclose(r.to_array(), a)
    for name in ("a.parquet", "a.csv", "a.asc"):
        r.write(f"file://{tmp_path}/{name}")
        back = Raster.open(spark, f"file://{tmp_path}/{name}", grid)
        np.testing.assert_allclose(back.to_array(6, 7), a)
    assert back.grid.transform == pytest.approx(grid.transform)
    assert "nmad" in r.info(True) and r.ccrs is None and r.set_vcrs("EGM96").ccrs == "EGM96"
    assert Raster.open(spark, f"file://{tmp_path}/a.csv", grid, downsample=2).df.count() == 12
    p = r.to_points()
    assert p.df.count() == 41 and p.crop(100, 110, 195, 200).df.count() == 2 and p.subsample(5).df.count() == 5
    p.df.select("x", "y", "z").select(F.concat_ws(" ", "x", "y", "z").alias("value")).write.text(f"file://{tmp_path}/p.xyz")
    assert PointCloud.open(spark, f"file://{tmp_path}/p.xyz").df.count() == 41
    assert r.slope(surface_fit="Horn").columns == ["row", "col", "slope"]
    z = r.interp_points(p.df).where("z_raster is not null and abs(z - z_raster) < 1e-9")
    assert z.count() == 41
    with pytest.raises(NotImplementedError):
        files.read_raster(spark, "a.tif")
    nested = spark.createDataFrame([("x", [[1.0, 2.0], [float("nan"), 4.0]])], "name string, values array<array<double>>")
    assert np.array_equal(to_array(from_nested(nested), 2, 2), [[1, 2], [np.nan, 4]], equal_nan=True)
    smooth = np.add.outer(np.sin(np.arange(30) / 4), np.cos(np.arange(30) / 3)) * 10
    one = Raster.from_array(spark, smooth, grid)
    lower = Raster.from_array(spark, smooth - 2, grid)
    aligned, fit = lower.coregister_3d(one, align.VerticalShift())
    assert np.allclose(aligned.to_array(30, 30), smooth) and fit.translations[2] == pytest.approx(2)
    moved, _ = lower.to_points().coregister_3d(one, align.VerticalShift())
    assert moved.df.agg(F.avg("z")).first()[0] == pytest.approx(smooth.mean(), abs=1e-6)


def test_uncertainty(spark):
    rng = np.random.default_rng(5)
    base = np.add.outer(np.sin(np.arange(40) / 4), np.cos(np.arange(40) / 3)) * 10
    a, b = (Raster.from_array(spark, base + rng.normal(0, 1, base.shape)) for _ in range(2))
    for approach in ("H2022", "R2009", "Basic"):
        sigma, models = a.estimate_uncertainty(b, approach=approach, precision_of_other="same", subsample=300, bins=4)
        assert sigma.agg(F.avg("sigma")).first()[0] == pytest.approx(1.0, abs=0.25)
        assert len(models) == (2 if approach == "H2022" else 1)
    with pytest.raises(ValueError):
        a.estimate_uncertainty(b, approach="x")


def test_workflows(spark, tmp_path):
    z = np.add.outer(np.sin(np.arange(30) / 4), np.cos(np.arange(30) / 3)) * 10
    for name, v in (("ref", z), ("tba", z - 3)):
        files.write_raster(from_array(spark, v), f"file://{tmp_path}/{name}.parquet")
    source = lambda n: {"path_to_elev": f"file://{tmp_path}/{n}.parquet"}
    out = workflows.topo(spark, {"inputs": {"reference_elev": source("ref")}, "outputs": {"path": f"file://{tmp_path}/topo"}, "statistics": ["mean", "nmad"]})
    assert out["attributes"].columns == ["row", "col", "slope", "aspect", "max_curvature"]
    assert spark.read.csv(f"file://{tmp_path}/topo/statistics.csv", header=True).columns == ["mean", "nmad"]
    config = {"inputs": {"reference_elev": source("ref"), "to_be_aligned_elev": source("tba")}, "coregistration": {"step_one": {"method": "VerticalShift"}}}
    out = workflows.accuracy(spark, config, write=False)
    assert out["statistics_before"].first()["median"] == pytest.approx(3) and out["statistics_after"].first()["median"] == pytest.approx(0, abs=1e-9)
    assert out["histogram"].agg(F.sum("count")).first()[0] == 1800
    for bad in ({}, {"inputs": {"reference_elev": source("x")}, "colour": 1}, {"inputs": {"reference_elev": source("x")}, "statistics": ["mode"]}, {"inputs": {"reference_elev": {**source("x"), "to_vcrs": "moon"}}}):
        with pytest.raises(ValueError):
            workflows.validate(bad, workflows.TOPO)
    with open(tmp_path / "c.yaml", "w") as f:
        f.write("inputs:\n  reference_elev:\n    path_to_elev: a\n    to_vcrs: 'None'\n")
    assert workflows.load_config(str(tmp_path / "c.yaml"))["inputs"]["reference_elev"]["to_vcrs"] is None


def test_streams_add_up(spark, tmp_path):
    src, out, grid = f"file://{tmp_path}/in", f"file://{tmp_path}/sums", Grid(area_or_point="Point")
    schema = "x double, y double, z double"
    for k in range(2):
        spark.createDataFrame([(0.0, 0.0, 1.0 + k), (1.0, -2.0, 5.0), (1.0, 0.0, None)], schema).write.mode("append").parquet(src)
        surface.follow(spark.readStream.schema(schema).parquet(src), grid, out, f"file://{tmp_path}/cp").awaitTermination()
    assert {(r.row, r.col): (r.z, r.n) for r in surface.surface(spark, out).collect()} == {(0, 0): (1.5, 2), (2, 1): (5.0, 2)}


def test_genton_uses_all_pairs(spark):
    z = np.random.default_rng(3).gamma(0.7, 10.0, size=(24, 30)).round(2)
    z[5, 5] = np.nan
    z[:, 20:] = np.round(z[:, 20:])  # with many ties
    got = {r.lags: (r.exp, r["count"]) for r in geostat.near_variogram(from_array(spark, z), [1.0, 1.5, 2.0], "genton").collect()}
    for lag, offsets in ((1.0, [(0, 1), (1, 0)]), (1.5, [(1, 1), (1, -1)]), (2.0, [(0, 2), (2, 0)])):
        v = []
        for i, j in offsets:
            a, b = z[: len(z) - i, max(0, -j) : 30 - max(0, j)], z[i:, max(0, j) : 30 + min(0, j)]
            v.append((a - b).ravel())
        v = np.concatenate(v)
        v = v[~np.isnan(v)]
        # the sign of a pair follows a hash of its cells
        assert got[lag][1] == len(v) > 500
        assert got[lag][0] > 0
    signed = spark.createDataFrame([(0, 1.0, float(x)) for x in v] + [(1, 1.0, 2.0)], "run int, lags double, signed double")
    d = np.sort(np.abs(v[:, None] - v[None, :])[np.triu_indices(len(v), 1)])
    h = len(v) // 2 + 1
    rows = {r.run: (r.exp, r["count"]) for r in geostat._estimate(signed.withColumn("d", F.abs("signed")).withColumn("key", F.xxhash64("signed")), ["run", "lags"], "genton").collect()}
    assert rows[0] == (pytest.approx(0.5 * (2.219 * d[h * (h - 1) // 2 - 1]) ** 2, rel=1e-9), len(v))
    assert rows[1] == (None, 1)
