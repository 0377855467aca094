"""Options of jobs and operators beyond their defaults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus import workflows
from talus.grid import Grid, from_array, to_array
from talus.operators import fitting, geostat, hypso, stats
from talus.sources import files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("jobs")
    z = np.add.outer(np.sin(np.arange(40) / 4), np.cos(np.arange(40) / 3)) * 10
    for name, v in (("ref", z), ("tba", z - 3 - 0.1 * np.arange(40))):
        files.write_raster(from_array(spark, v), f"file://{path}/{name}.parquet")
    spark.createDataFrame([(0, 0), (5, 7), (5, 7)], "row int, col int").write.parquet(f"file://{path}/mask.parquet")
    return f"file://{path}"


def test_topo_takes_several_sources(spark, folder):
    config = {
        "inputs": [{"path_to_elev": f"{folder}/ref.parquet", "path_to_mask": f"{folder}/mask.parquet"}, {"path_to_elev": f"{folder}/tba.parquet", "downsample": 2}],
        "outputs": {"path": f"{folder}/topo", "level": 1},
        "statistics": ["validcount", "totalcount"],
        "terrain_attributes": {"slope": {"surface_fit": "ZevenbergThorne"}, "roughness": None},
    }
    out = workflows.topo(spark, config)
    assert set(out) == {"dem_0", "dem_1"} and out["dem_0"]["attributes"].columns == ["row", "col", "slope", "roughness"]
    assert [out[k]["statistics"].first().asDict() for k in ("dem_0", "dem_1")] == [{"validcount": 1598, "totalcount": 1600}, {"validcount": 400, "totalcount": 400}]
    assert spark.read.csv(f"{folder}/topo/dem_1/statistics_slope.csv", header=True).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/topo/dem_0/attributes.parquet")
    one = workflows.topo(spark, {"inputs": config["inputs"][0], "statistics": None, "terrain_attributes": None}, write=False)
    assert set(one) == {"profile_rows", "profile_columns"}


def test_topo_converts_heights(spark, folder):
    source = {"path_to_elev": f"{folder}/ref.parquet", "from_vcrs": "EGM96", "to_vcrs": "Ellipsoid"}
    geoid = from_array(spark, np.full((50, 50), 17.0)), Grid()
    out = workflows.topo(spark, {"inputs": [source], "statistics": ["mean"], "terrain_attributes": None}, write=False, geoids={"EGM96": geoid})
    plain = workflows.topo(spark, {"inputs": [{**source, "to_vcrs": None}], "statistics": ["mean"], "terrain_attributes": None}, write=False)
    assert out["statistics"].first()["mean"] == pytest.approx(plain["statistics"].first()["mean"] + 17, abs=0.5)
    with pytest.raises(ValueError, match="EGM96"):
        workflows.topo(spark, {"inputs": [source]}, write=False)


def test_accuracy_takes_bias_steps(spark, folder):
    inputs = {k: {"path_to_elev": f"{folder}/{n}.parquet"} for k, n in (("reference_elev", "ref"), ("to_be_aligned_elev", "tba"))}
    steps = {"step_one": {"method": "VerticalShift"}, "step_two": {"method": "DirectionalBias", "extra_information": {"how": "bin", "bins": 20}}, "step_three": {"method": None, "extra_information": None}}
    out = workflows.accuracy(spark, {"inputs": inputs, "coregistration": steps, "outputs": {"level": 2}, "statistics": ["median", "nmad"]}, write=False)
    before, after = out["statistics_before"].first(), out["statistics_after"].first()
    assert after["nmad"] < before["nmad"] / 5 and after["median"] == pytest.approx(0, abs=0.1)
    assert {"reference_elev", "to_be_aligned_elev", "dh_aligned", "statistics_reference_elev", "statistics_aligned"} <= set(out)
    terrain = {"step_one": {"method": "TerrainBias", "extra_information": {"attribute": "slope", "bins": 5}}}
    assert workflows.validate({"inputs": inputs, "coregistration": terrain}, workflows.ACCURACY)["coregistration"]["process"]
    for bad in ({"coregistration": {"step_one": {"method": None}}}, {"outputs": {"level": 3}}, {"inputs": {**inputs, "sampling_grid": None}}, {"coregistration": {"step_four": {"method": "LZD"}}}):
        with pytest.raises(ValueError):
            workflows.validate({"inputs": inputs, **bad}, workflows.ACCURACY)
    plain = workflows.accuracy(spark, {"inputs": {**inputs, "sampling_grid": None}, "coregistration": {"process": False}, "statistics": None}, write=False)
    assert set(plain) == {"dh_before"}


def test_binning_options(spark):
    rows = [(float(k % 7), float(k), None if k == 3 else float(k * k)) for k in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, v double")
    got = stats.nd_binning(df, "v", {"b": 5}, {"mean": F.avg, "top": F.max}).orderBy("b.left").collect()
    b, v = np.array([[r[1], r[2]] for r in rows if r[2] is not None]).T
    edges = np.linspace(0, 49, 6)
    which = np.minimum(4, np.digitize(b, edges) - 1)
    assert [r["mean"] for r in got] == pytest.approx([v[which == k].mean() for k in range(5)])
    assert [r["top"] for r in got] == [v[which == k].max() for k in range(5)]
    assert [tuple(r["b"]) for r in got] == [pytest.approx(tuple(e)) for e in zip(edges, edges[1:], strict=False)]
    assert stats.nd_binning(df, "v", ["a", "b"], ranges={"b": (0.0, 10.0)}).where("nd = 1 and b is not null").agg(F.sum("count")).first()[0] == 10
    assert stats.bin_edges(spark.createDataFrame([(2.0, 1.0)], "a double, v double"), "v", ["a"]) == {"a": [1.5, 2.5]}
    with pytest.raises(ValueError, match="no row"):
        stats.nd_binning(df.limit(0), "v", ["a"])
    with pytest.raises(ValueError, match="names"):
        stats.nd_binning(df, "v", {"a": 2}, {"nmad": F.avg})


@pytest.mark.parametrize("estimator", ["theil-sen", "ransac"])
def test_fits_by_subsets_bear_outliers(spark, estimator):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, 2000)
    y = 1 + 2 * x + rng.normal(0, 0.02, len(x))
    y[:300] += 30
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(0.5, 2.0)] * 100 + [(None, 1.0), (1.0, None)], "x double, y double")
    c = fitting.subset_fit(df, [F.lit(1.0), F.col("x")], F.col("y"), estimator)
    assert c == pytest.approx([1, 2], abs=0.35 if estimator == "theil-sen" else 0.05)
    found, order = fitting.fit_polynomial(df, "x", "y", 2, estimator=estimator)
    assert order == 1 and found == pytest.approx(list(c), abs=0.05)
    with pytest.raises(ValueError):
        fitting.subset_fit(df.limit(0), [F.lit(1.0), F.col("x")], F.col("y"), estimator)
    with pytest.raises(ValueError):
        fitting.fit_polynomial(df, "x", "y", 2, estimator="least")


@pytest.mark.parametrize("shape", ["square", "circular"])
def test_patches_by_quadrant(spark, shape):
    z = np.random.default_rng(2).normal(size=(43, 38))
    z[0:8, 0:8] = np.nan
    size, radius = 6, round((36 / np.pi) ** 0.5)
    i, j = np.indices(z.shape)
    want = {}
    for a in range(43 // size + 1):
        for b in range(38 // size + 1):
            if shape == "square":
                held = (i // size == a) & (j // size == b)
                full = 36
            else:
                held = (i - int(size * (a + 0.5))) ** 2 + (j - int(size * (b + 0.5))) ** 2 < radius * radius
                full = sum(p * p + q * q < radius * radius for p in range(-9, 10) for q in range(-9, 10))
            v = z[held]
            if len(v) == full and np.isfinite(v).sum() >= np.ceil(0.8 * full):
                want[a, b] = np.nanmean(v)
    laid, summary = geostat.patches_by_quadrant(from_array(spark, z), 36.0, shape=shape)
    assert {(r.i, r.j): r["mean"] for r in laid.collect()} == pytest.approx(want)
    v = np.array(list(want.values()))
    assert summary["nmad"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v)))) and summary["nb_indep_patches"] == len(v) and summary["exact_areas"] == full
    assert geostat.patches_by_quadrant(from_array(spark, z), 36.0, n_patches=5, shape=shape)[1]["nb_indep_patches"] == 5
    assert np.isnan(geostat.patches_by_quadrant(from_array(spark, z), 1e6, shape=shape)[1]["nmad"])


def test_fill_switches(spark):
    z = np.arange(400.0).reshape(20, 20)
    z[9:11, 9:11] = np.nan  # a small gap inside
    z[:, 16:] = np.nan  # a void at the edge
    df = from_array(spark, z)
    closed = to_array(hypso.fill_idw(df, 5, "z", extrapolate=False), 20, 20)
    assert np.isfinite(closed[:, :16]).all() and np.isnan(closed[:, 16:]).all()
    assert np.array_equal(closed[:9, :9], z[:9, :9])
    open_ended = to_array(hypso.fill_idw(df, 3, "z"), 20, 20)
    assert np.isfinite(open_ended[:, 16]).all() and np.isnan(open_ended[:, 19]).all()
    forced = to_array(hypso.fill_idw(df, 5, "z", extrapolate=False, force=True), 20, 20)
    assert (forced[:, 16:] == np.nanmedian(z)).all()
    empty = from_array(spark, np.full((3, 3), np.nan))
    assert np.isnan(to_array(hypso.fill_idw(empty, 4, "z", False, True), 3, 3)).all()


@pytest.mark.parametrize("method", ["pdist_disk", "pdist_ring"])
def test_pairs_of_several_ranges(spark, method):
    rng = np.random.default_rng(8)
    rows = [(k, float(k % 30), float(k // 30), float(v)) for k, v in enumerate(rng.normal(size=900))]
    df = spark.createDataFrame([*rows, (900, 1.0, 1.0, None)], "pid int, x double, y double, z double")
    edges = [2.0, 4.0, 8.0, 16.0, 100.0]
    got = geostat.variogram(df, edges, "matheron", 200, method, runs=3).orderBy("lags").toPandas()
    assert got["lags"].tolist() == edges[:-1] and got["exp"].tolist() == pytest.approx([1.0] * 4, abs=0.25)
    # one range that holds all points gives all pairs, and one that holds few gives short ones only
    whole = geostat.variogram(df, edges, "matheron", 2000, method, ranges=[100.0]).orderBy("lags").toPandas()
    p = np.array(rows)
    h = np.hypot(p[:, None, 1] - p[None, :, 1], p[:, None, 2] - p[None, :, 2])[np.triu_indices(900, 1)]
    d = (p[:, None, 3] - p[None, :, 3])[np.triu_indices(900, 1)]
    for k, lag in enumerate(edges[:-1]):
        held = (h <= lag) & (h > ([0, *edges][k]))
        assert whole["count"][k] == held.sum() and whole["exp"][k] == pytest.approx((d[held] ** 2).mean() / 2)
    assert geostat.variogram(df, edges, "matheron", 200, method, ranges=[2.0]).agg(F.max("lags")).first()[0] <= 4.0
    assert geostat.variogram(df.limit(0), edges, "matheron", 200, method).count() == 0
    with pytest.raises(ValueError):
        geostat.variogram(df, edges, "matheron", 200, method, ranges=[0.0])
