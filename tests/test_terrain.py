import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.grid import Grid, from_array, to_array
from talus.operators import terrain


def attribute(spark, z, name, **options):
    out = terrain.terrain_attributes(from_array(spark, z), name, **options)
    return to_array(out, *np.shape(z), column=name)


def plane(a, b, n=9, res=2.0):
    r, c = np.indices((n, n))
    return a * c * res - b * r * res  # a eastward, b northward


def test_slope_and_aspect_of_planes(spark):
    for a, b, facing in ((1.0, 0.0, 270.0), (-1.0, 0.0, 90.0), (0.0, 1.0, 180.0), (0.0, -1.0, 0.0)):
        for fit in ("Horn", "ZevenbergThorne", "Florinsky"):
            s = attribute(spark, plane(a, b), "slope", resolution=2.0, surface_fit=fit)
            d = attribute(spark, plane(a, b), "aspect", resolution=2.0, surface_fit=fit)
            assert s[4, 4] == pytest.approx(45.0)
            assert min(abs(d[4, 4] - facing), 360 - abs(d[4, 4] - facing)) < 1e-6


def test_borders_and_gaps_are_missing(spark):
    z = plane(1.0, 0.5)
    z[4, 4] = np.nan
    for fit, k in (("Horn", 1), ("Florinsky", 2)):
        s = attribute(spark, z, "slope", surface_fit=fit)
        want = np.zeros(z.shape, bool)
        want[k:-k, k:-k] = True
        want[4 - k : 5 + k, 4 - k : 5 + k] = False
        assert (np.isfinite(s) == want).all()


def test_curvatures_of_a_paraboloid(spark):
    r, c = np.indices((11, 11)) - 5.0
    z = 0.02 * c * c + 0.01 * r * r  # a bowl: at its bottom slopes vanish
    for fit in ("ZevenbergThorne", "Florinsky"):
        assert attribute(spark, z, "curvature", surface_fit=fit)[5, 5] == pytest.approx(-2 * (0.04 + 0.02) * 100)
        if fit == "ZevenbergThorne":  # where the slope is exactly zero the rule for flat cells holds
            assert attribute(spark, z, "max_curvature", surface_fit=fit)[5, 5] == 0.0
        p, q = 0.04 * 2, 0.0
        g = p * p
        h = -((1 + q * q) * 0.04 + (1 + p * p) * 0.02) / (2 * math.sqrt((1 + g) ** 3))
        spread = math.sqrt(h * h - (0.04 * 0.02 / (1 + g) ** 2) ** 1 * 1.0)
        assert attribute(spark, z, "max_curvature", surface_fit=fit)[5, 7] == pytest.approx(100 * (h + spread), rel=1e-6)
        assert attribute(spark, z, "profile_curvature", surface_fit=fit)[5, 7] == pytest.approx(-100 * 0.04 / math.sqrt((1 + g) ** 3), rel=1e-6)


def test_rugosity_examples(spark):
    z = np.array([[190, 170, 155], [183, 165, 145], [175, 160, 122]], float)
    assert attribute(spark, z, "rugosity", resolution=100.0)[1, 1] == pytest.approx(10280.48 / 10000, rel=1e-4)
    for dh in (0.0, 1.0, 5.0):
        z = np.ones((3, 3))
        z[1, 1] += dh
        side, diagonal = math.sqrt(1 + dh * dh), math.sqrt(2 + dh * dh)
        s = (1 + side + diagonal) / 2
        assert attribute(spark, z, "rugosity")[1, 1] == pytest.approx(2 * math.sqrt(s * (s - 1) * (s - side) * (s - diagonal)))


def test_fractal_dimension_of_a_line_a_plane_and_a_cube(spark):
    line, flat, cube = np.zeros((13, 13)), np.zeros((13, 13)), np.zeros((13, 13))
    line[1, 1], flat[:, 1], cube[:, :6] = 6.5, 13, 13
    for z, d in ((line, 1), (flat, 2), (cube, 3)):
        assert round(attribute(spark, z, "fractal_roughness")[6, 6], 5) == d


def test_windowed_attributes_equal_numpy(spark):
    rng = np.random.default_rng(42)
    z = rng.normal(size=(15, 15))
    z[5, 5] = np.nan
    for w in (3, 5):
        k = w // 2
        for i, j in ((7, 8), (9, 9), (4, 12), (5, 6), (0, 0)):
            win = z[max(0, i - k) : i + k + 1, max(0, j - k) : j + k + 1]
            full = win.size == w * w and np.isfinite(win).all()
            for name, value in (
                ("topographic_position_index", z[i, j] - (win.sum() - z[i, j]) / (w * w - 1)),
                ("roughness", win.max() - win.min()),
                ("terrain_ruggedness_index", math.sqrt(((win - z[i, j]) ** 2).sum()) if full else 0),
            ):
                got = attribute(spark, z, name, window_size=w)[i, j] if name == "roughness" or (i, j) == (7, 8) else None
                if got is not None:
                    assert got == pytest.approx(value) if full else np.isnan(got)


def test_tiles_change_nothing(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 33)) * 5
    z[10, 20] = np.nan
    a = attribute(spark, z, "fractal_roughness", tile=256)
    b = attribute(spark, z, "fractal_roughness", tile=8)
    np.testing.assert_allclose(a, b)


def test_texture_shading(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(20, 30))
    z[3, 4] = np.nan
    t = attribute(spark, z, "texture_shading")
    assert np.isnan(t[3, 4]) and np.isfinite(t).sum() == 599
    assert attribute(spark, np.full((8, 8), 5.0), "texture_shading") == pytest.approx(np.zeros((8, 8)), abs=1e-9)
    np.testing.assert_allclose(terrain.texture_array(z, 0.0)[5:, 5:], z[5:, 5:], atol=1e-9)
    assert [terrain._fft_size(n) for n in (1, 5, 1024, 1025, 1100)] == [1, 8, 1024, 1029, 1120]
    with pytest.raises(ValueError):
        terrain.texture_shading(from_array(spark, z), 3.0)


@settings(max_examples=5, deadline=None)
@given(st.floats(-1000, 1000))
def test_heights_may_be_lifted(spark, lift):
    r, c = np.indices((7, 7))
    z = np.sin(r) + np.cos(2.0 * c)
    np.testing.assert_allclose(attribute(spark, z + lift, "slope"), attribute(spark, z, "slope"), atol=1e-6)


def test_arguments(spark):
    z = from_array(spark, np.zeros((5, 5)))
    for bad in (dict(attributes="nothing"), dict(attributes="max_curvature", surface_fit="Horn"), dict(attributes="slope", surface_fit="x"), dict(attributes="roughness", window_size=4), dict(attributes="hillshade", hillshade_azimuth=400), dict(attributes="max_curvature", curv_method="x"), dict(attributes="fractal_roughness", window_size_fractal=3)):
        with pytest.raises(ValueError):
            terrain.terrain_attributes(z, **bad)
    with pytest.raises(ValueError):
        _ = Grid(transform=(1.0, 0, 0, 0, -2.0, 0)).resolution
