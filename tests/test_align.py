import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions import numeric
from talus.grid import Grid, from_array, to_array
from talus.operators import align, biascorr, blockwise, fitting, resample

GRID = Grid(transform=(10.0, 0.0, 1000.0, 0.0, -10.0, 5000.0))
N = 40


def hills(rows=np.arange(N), cols=np.arange(N)):
    r, c = np.meshgrid(rows, cols, indexing="ij")
    return 20 * np.sin(r / 5) + 15 * np.cos(c / 4) + 8 * np.sin((r + 2 * c) / 9)


def pair(spark, east=0.6, north=-0.4, up=3.0):
    """A surface and what has to move by (east, north) cells and up to become it."""
    moved = hills(np.arange(N) - north, np.arange(N) + east) - up
    return from_array(spark, hills()), from_array(spark, moved)


@pytest.mark.parametrize("method", [align.NuthKaab(), align.DhMinimize(tolerance=0.1), align.LZD(only_translation=True)], ids=["nk", "dh", "lzd"])
def test_shifts_are_recovered(spark, method):
    ref, tba = pair(spark)
    fit = method.fit(ref, tba, GRID)
    assert fit.translations == pytest.approx((6.0, -4.0, 3.0), abs=0.5)
    aligned, _ = fit.apply(tba, GRID)
    left = to_array(aligned, N, N) - hills()
    assert np.nanstd(left[2:-2, 2:-2]) < 0.1 * np.nanstd(to_array(tba, N, N) - hills())


def test_icp_and_cpd(spark):
    ref, tba = pair(spark, 0.3, -0.2)
    for method in (align.ICP(only_translation=True), align.ICP(method="point-to-point", only_translation=True), align.CPD(subsample=600, only_translation=True, max_iterations=40)):
        t = method.fit(ref, tba, GRID).translations
        assert t[2] == pytest.approx(3.0, abs=1.0)
    assert align.ICP(only_translation=True).fit(ref, tba, GRID).translations[:2] == pytest.approx((3.0, -2.0), abs=0.6)


def test_nearest_is_nearest_however_far(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.uniform(0, 40, (60, 3)), [[500.0, -300.0, 0.0], [20.0, 20.0, 400.0], [3.0, 3.0, -90.0]]])
    b = np.concatenate([rng.uniform(0, 40, (80, 3)) * [1, 1, 5], [[-700.0, 90.0, 3.0], [900.0, 900.0, 1.0], [20.0, 80.0, 399.0]]])
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(a)], "pid long, x double, y double, z double")
    others = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(b)] + [(-1, 3.0, 3.0, None)], "oid long, ox double, oy double, oz double")
    got = {r.pid: r.oid for r in align.nearest(points, others, 2.0).collect()}
    want = np.argmin(((a[:, None] - b[None]) ** 2).sum(axis=2), axis=1)
    assert got == dict(enumerate(want.tolist()))
    assert len(align.nearest(points, others, 2.0, reach=1).collect()) < len(got)
    assert align.nearest(points, others.limit(0), 2.0).count() == 0


@pytest.mark.parametrize(("query", "method"), [("nuth_kaab", align.NuthKaab), ("dh_minimize", align.DhMinimize), ("lzd", align.LZD), ("icp", align.ICP), ("cpd", align.CPD), ("pipeline_vshift_nk", align.NuthKaab)])
def test_registered_fits_use_the_defaults(spark, monkeypatch, query, method):
    from talus.queries import alignment

    class Asked(Exception):
        pass

    def fit(self, *args):
        raise Asked(self)

    monkeypatch.setattr(method, "fit", fit)
    with pytest.raises(Asked) as asked:
        alignment.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert asked.value.args[0] == method()
    assert align.LZD().max_iterations == 200


def test_cpd_raises_above_its_bound(spark, monkeypatch):
    ref, tba = pair(spark, 0.3, -0.2)
    with pytest.raises(ValueError, match="at most 20000"):
        align.CPD(subsample=50_000).fit(ref, tba, GRID)
    monkeypatch.setattr(align, "MOST", 1000)
    with pytest.raises(ValueError, match="at most 1000"):
        align.CPD(subsample=1).fit(ref, tba, GRID)


def test_rotations_are_recovered(spark):
    ref = from_array(spark, hills())
    m = resample.matrix(2.0, -1.0, 1.0, 0.3, -0.2, 0.5)
    centre = (1200.0, 4800.0, 0.0)
    tba, _ = resample.apply_to_raster(ref, GRID, resample.invert(m), centre)
    fit = align.LZD(max_iterations=15).fit(ref, tba, GRID)
    aligned, _ = fit.apply(tba, GRID)
    left = to_array(aligned, N, N) - hills()
    before = to_array(tba, N, N) - hills()
    assert np.nanstd(left[3:-3, 3:-3]) < 0.2 * np.nanstd(before[3:-3, 3:-3])


def test_vertical_shift_masks_and_errors(spark):
    ref, _ = pair(spark)
    tba = ref.withColumn("z", F.when(F.col("row") < 10, F.col("z") - 50).otherwise(F.col("z") - 2))
    assert align.VerticalShift().fit(ref, tba, GRID, ref.where("row >= 10")).translations == pytest.approx((0, 0, 2))
    with pytest.raises(ValueError):
        align.VerticalShift().fit(ref, tba.withColumn("z", F.lit(None).cast("double")), GRID)
    with pytest.raises(NotImplementedError):
        align.Method().fit(ref, tba, GRID)


def test_pipelines(spark):
    ref, tba = pair(spark)
    steps = align.VerticalShift() + align.NuthKaab(max_iterations=5) + biascorr.Deramp(order=0)
    assert len(steps.steps) == 3
    aligned, fit = steps.fit_and_apply(ref, tba, GRID)
    left = to_array(aligned, N, N) - hills()
    assert np.nanstd(left[3:-3, 3:-3]) < 0.5
    with pytest.raises(ValueError):
        _ = fit.matrix
    two = (align.VerticalShift() + align.VerticalShift()).fit(ref, tba, GRID)
    assert two.matrix[2, 3] == pytest.approx(sum(f.matrix[2, 3] for f in two.fits))


def test_matrices(spark):
    m = resample.matrix(1, 2, 3, 10, 20, 30)
    assert resample.decompose(m) == pytest.approx((1, 2, 3, 10, 20, 30))
    np.testing.assert_allclose(m @ resample.invert(m), np.eye(4), atol=1e-12)
    np.testing.assert_allclose(resample.make_valid(m + 1e-4)[:3, :3] @ resample.make_valid(m + 1e-4)[:3, :3].T, np.eye(3), atol=1e-12)
    assert resample.decompose(resample.matrix(0, 0, 0, 0, 90, 30))[4] == pytest.approx(90, abs=1e-4)
    for bad in (np.eye(3), np.diag([2.0, 1, 1, 1]), np.full((4, 4), np.nan)):
        with pytest.raises(ValueError):
            resample.check(bad)
    points = spark.createDataFrame([(1, 1.0, 1.0, 0.0), (2, 2.0, 2.0, 0.0), (3, 3.0, 3.0, None)], "pid long, x double, y double, z double")
    there = resample.apply_to_points(points, m, (1.0, 0.0, 2.0))
    back = resample.apply_to_points(there, m, (1.0, 0.0, 2.0), inverse=True)
    # a transform about a centroid is undone about that centroid
    assert [(round(r.x, 9), round(r.y, 9)) for r in back.orderBy("pid").limit(2).collect()] == [(1.0, 1.0), (2.0, 2.0)]


def test_interpolation_and_shift(spark):
    z = np.arange(20.0).reshape(4, 5)
    z[2, 2] = np.nan
    df = from_array(spark, z)
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 2.0), (3, 0.0, 4.0), (4, 3.0, 4.5), (5, 1.5, 1.5)], "pid long, prow double, pcol double")
    got = {r.pid: r.v for r in resample.interp(pts, df, {"v": "z"}).collect()}
    assert got[1] == pytest.approx(3.0) and got[3] == 4.0 and got[2] is None and got[4] is None and got[5] is None
    moved = to_array(resample.shift(df, 1, 0), 4, 5)
    np.testing.assert_allclose(moved[1:], z[:-1])
    assert np.isnan(moved[0]).all()


def test_bias_corrections(spark):
    ref = from_array(spark, hills())
    r, c = np.indices((N, N))
    ramp = from_array(spark, hills() - (0.02 * c * c - 0.3 * r + 0.01 * r * c + 4))
    out, _ = biascorr.Deramp().fit(ref, ramp, GRID).apply(ramp, GRID)
    np.testing.assert_allclose(to_array(out, N, N), hills(), atol=1e-6)
    wave = from_array(spark, hills() - 3 * np.sin(2 * np.pi * c / 15 + 0.5))
    out, _ = biascorr.DirectionalBias(0.0, bins=40).fit(ref, wave, GRID).apply(wave, GRID)
    assert np.std(to_array(out, N, N) - hills()) < 0.3
    steps = from_array(spark, hills() - np.where(c < 20, 2.0, -1.0))
    cols = lambda df, grid: df.withColumn("_c", F.col("col").cast("double"))
    for how in ("bin", "bin_and_fit", "fit"):
        out, _ = biascorr.BiasCorr(["_c"], cols, how, 40).fit(ref, steps, GRID).apply(steps, GRID)
        assert np.std(to_array(out, N, N) - hills()) < 0.7
    both = lambda df, grid: df.withColumns({"_c": F.col("col").cast("double"), "_r": F.col("row").cast("double")})
    out, _ = biascorr.BiasCorr(["_c", "_r"], both, "bin", 4).fit(ref, steps, GRID).apply(steps, GRID)
    assert np.nanstd(to_array(out, N, N) - hills()) < 0.7
    with pytest.raises(ValueError):
        biascorr.BiasCorr(["_c"], cols, "guess").fit(ref, steps, GRID)


def test_blockwise(spark):
    ref, tba = pair(spark, 0.5, 0.3)
    b = blockwise.BlockwiseCoreg(tile=20, threshold=1.0)
    rows = b.shifts(ref, tba, GRID).toPandas()
    assert len(rows) == 4
    assert rows["shift_x"].median() == pytest.approx(5.0, abs=1.0) and rows["shift_z"].median() == pytest.approx(3.0, abs=0.5)
    out, _ = b.fit(ref, tba, GRID).apply(tba, GRID)
    left = to_array(out, N, N) - hills()
    assert np.nanstd(left[4:-4, 4:-4]) < 0.5 * np.nanstd(to_array(tba, N, N) - hills())


def test_solvers():
    x, y = np.meshgrid(np.arange(6.0), np.arange(5.0))
    v = 2 * x - 3 * y + 1
    v[2, 3] = 100
    assert numeric.ransac_plane(x.ravel(), y.ravel(), v.ravel()) == pytest.approx((2, -3, 1))
    assert numeric.ransac_plane(np.arange(4.0), np.zeros(4), np.arange(4.0) * 2 + 1) == pytest.approx((2, 0, 1))
    assert numeric.nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, np.zeros(2))[0] == pytest.approx([3, -1], abs=1e-2)
    knots = np.linspace(0, 3, 20)
    assert numeric.natural_spline(knots, np.sin(knots), np.array([1.03])) == pytest.approx(np.sin([1.03]), abs=1e-3)
    assert numeric.gauss_legendre(np.cos, 0, np.pi / 2) == pytest.approx(1.0)
    assert fitting.best_order([10.0, 1.1, 1.0, 0.99]) == 1


def test_robust_polynomial_and_sines(spark):
    rng = np.random.default_rng(42)
    x = np.linspace(-10, 10, 500)
    y = -100 + 5 * x + 3 * x**2 + 2 * x**3 + rng.normal(0, 3, 500)
    y[50:75] = 0
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    c, order = fitting.fit_polynomial(df, "x", "y", 4)
    assert order == 3 and c[:4] == pytest.approx([-100, 5, 3, 2], abs=4)
    xs = np.linspace(0, 100, 200)
    p = fitting.fit_sines(xs, 5 * np.sin(2 * np.pi / 30 * xs + 1) + 2 * np.sin(2 * np.pi / 8 * xs), 2)
    assert p[0] == pytest.approx(5, abs=0.3) and p[1] == pytest.approx(30, abs=0.5)


def scattered(spark, dx=0.0, dy=0.0, dz=0.0, n=900, seed=3):
    """Points on the hills, by bilinear interpolation, moved away by (dx, dy, dz)."""
    z = hills()
    rng = np.random.default_rng(seed)
    r, c = rng.uniform(6, N - 8, (2, n))
    i, j = r.astype(int), c.astype(int)
    a, b = r - i, c - j
    h = z[i, j] * (1 - a) * (1 - b) + z[i + 1, j] * a * (1 - b) + z[i, j + 1] * (1 - a) * b + z[i + 1, j + 1] * a * b
    row, col = spark.range(1).select(GRID.x(F.lit(0.0), F.lit(0.0)).alias("x"), GRID.y(F.lit(0.0), F.lit(0.0)).alias("y")).first()
    x, y = row + c * GRID.resolution, col - r * GRID.resolution
    rows = [(k, float(x[k] - dx), float(y[k] - dy), float(h[k] - dz)) for k in range(n)]
    return spark.createDataFrame(rows + [(n, None, 1.0, 2.0), (n + 1, 1.0, 1.0, None)], "pid long, x double, y double, z double")


@pytest.mark.parametrize("method", [align.VerticalShift(), align.NuthKaab(), align.LZD(only_translation=True, max_iterations=20), align.ICP(only_translation=True, max_iterations=30)])
def test_points_are_moved_onto_a_raster_and_back(spark, method):
    ref = from_array(spark, hills())
    shift = (0.0, 0.0, 4.0) if isinstance(method, align.VerticalShift) else (0.7 * GRID.resolution, -0.5 * GRID.resolution, 4.0)
    points = scattered(spark, *shift)
    fit = method.fit_points(ref, points, GRID)
    near = [0.12 * GRID.resolution, 0.12 * GRID.resolution, 0.6]
    assert all(abs(a - b) <= t for a, b, t in zip(fit.translations, shift, near, strict=True)), fit.translations
    back = method.fit_points(ref, points, GRID, points_are="ref")
    assert back.translations == pytest.approx([-v for v in fit.translations], abs=1e-6)
    with pytest.raises(ValueError):
        method.fit_points(ref, points, GRID, points_are="both")


def test_points_meet_points_and_pipelines_move_points(spark):
    ref, tba = scattered(spark, n=300), scattered(spark, 6.0, -4.0, 2.0, n=300)
    fit = align.CPD(only_translation=True, subsample=1).fit_point_point(ref, tba, GRID.resolution)
    assert fit.translations == pytest.approx((6.0, -4.0, 2.0), abs=1.0)
    met = align.ICP("point-to-point", only_translation=True, picky=False).fit_point_point(ref, tba, GRID.resolution)
    assert met.translations == pytest.approx((6.0, -4.0, 2.0), abs=1.5)
    with pytest.raises(ValueError):
        align.ICP().fit_point_point(ref, tba, 1.0)
    with pytest.raises(NotImplementedError):
        biascorr.Deramp().fit_points(from_array(spark, hills()), ref, GRID)
    steps = align.VerticalShift() + align.NuthKaab(max_iterations=4)
    fits = steps.fit_points(from_array(spark, hills()), scattered(spark, 0.0, 0.0, 5.0), GRID)
    assert fits.matrix[2, 3] == pytest.approx(5.0, abs=0.3)
    assert align.NuthKaab().info()["is_translation"] and not align.LZD().is_translation and not biascorr.Deramp.is_affine


def test_masks_hold_for_points(spark):
    ref = from_array(spark, hills())
    points = scattered(spark, 0.0, 0.0, 2.0).withColumn("z", F.when(GRID.place(F.col("x"), F.col("y"))[0] < N / 2, F.col("z") - 30).otherwise(F.col("z")))
    fit = align.VerticalShift().fit_points(ref, points, GRID, ref.where(f"row > {N // 2 + 1}"))
    assert fit.translations[2] == pytest.approx(2.0, abs=0.05)
