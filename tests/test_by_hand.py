"""Registered queries that SQL can't express, against plain arrays."""

import numpy as np
import pytest

from talus import catalog
from talus.grid import Grid
from talus.operators import biascorr
from talus.queries import volume
from talus.queries.alignment import pair
from talus.queries.statistics import sparse

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def cells(spark):
    ref, tba = (d.toPandas() for d in pair(spark, SF))
    return ref.merge(tba, on=["row", "col"], suffixes=("_ref", "_tba"))


def test_deramp(spark, cells):
    x, y = cells["col"].to_numpy(float) / cells["col"].max(), cells["row"].to_numpy(float) / cells["row"].max()
    terms = np.column_stack([x**i * y**j for i in range(3) for j in range(3)])
    dh = (cells["z_ref"] - cells["z_tba"]).to_numpy(float)
    want = cells["z_tba"].to_numpy(float) + terms @ np.linalg.lstsq(terms, dh, rcond=None)[0]
    got = cells[["row", "col"]].merge(run(spark, "deramp"), on=["row", "col"])["z"].to_numpy(float)
    assert got == pytest.approx(want, abs=1e-3)


def test_bias_polynomial(spark, cells):
    x, dh = cells["col"].to_numpy(float), (cells["z_ref"] - cells["z_tba"]).to_numpy(float)
    edges = np.linspace(x.min(), x.max(), 13)
    which = np.minimum(11, np.searchsorted(edges, x, "right") - 1)
    held = [k for k in range(12) if (which == k).any()]
    mid = (edges[:-1] + edges[1:])[held] / 2
    fit = np.polynomial.Polynomial.fit(mid, [np.median(dh[which == k]) for k in held], min(6, len(held) - 1))
    got = cells[["row", "col"]].merge(run(spark, "bias_polynomial"), on=["row", "col"])["z"].to_numpy(float)
    assert got == pytest.approx(cells["z_tba"].to_numpy(float) + fit(x), abs=1e-3)


def test_terrain_bias_lowers_medians_to_zero(spark, cells):
    """Without interpolation the median of what is left in each bin of the attribute is zero."""
    ref, tba = pair(spark, SF)
    step = biascorr.TerrainBias("slope", bins=4)
    step.interpolate = False
    fitted = step.fit(ref, tba, Grid())
    out = fitted.apply(tba, Grid())[0].toPandas().rename(columns={"z": "z_out"})
    slopes = step.with_variables(tba, Grid()).toPandas()[["row", "col", "_attribute"]]
    both = cells.merge(out, on=["row", "col"]).merge(slopes, on=["row", "col"]).dropna()
    v = both["_attribute"].to_numpy(float)
    which = np.minimum(3, np.searchsorted(np.linspace(v.min(), v.max(), 5), v, "right") - 1)
    left = (both["z_ref"] - both["z_out"]).to_numpy(float)
    assert [np.median(left[which == k]) for k in np.unique(which)] == pytest.approx([0.0] * len(np.unique(which)), abs=1e-6)


def test_hypsometric_curves(spark):
    """The spline and the polynomial through bins, from the bins of the surface."""
    d = volume.change(spark, SF).toPandas()
    d = d[d["z"].notna()]
    z, dh = d["z"].to_numpy(float), d["dh"].to_numpy(float)
    for name in ("hypso_interpolate", "hypso_polynomial"):
        t = run(spark, name).sort_values("left")
        counts = [int(np.isfinite(dh[(z >= a) & (z < b)]).sum()) for a, b in zip(t["left"], t["right"], strict=True)]
        assert np.abs(t["count"].to_numpy() - counts).max() <= 1  # edges are rounded
        assert t["value"].notna().all()
    t = run(spark, "hypso_interpolate").sort_values("left")
    for a, b, v, n in t[["left", "right", "value", "count"]].itertuples(index=False):
        if n >= 30:
            assert v == pytest.approx(np.nanmedian(dh[(z >= a - 1e-6) & (z < b - 1e-6)]), abs=0.05 * np.nanstd(dh))


def test_sample_is_of_the_cells(spark):
    got, every = run(spark, "sample_hash"), sparse(spark, SF).toPandas()
    assert len(got) == 500 and not got.duplicated(["row", "col"]).any()
    met = got.merge(every, on=["row", "col"], suffixes=("", "_cell"))
    assert len(met) == 500 and met["z"].to_numpy(float) == pytest.approx(met["z_cell"].to_numpy(float), abs=1e-6)
    assert got.sort_values(["row", "col"]).reset_index(drop=True).equals(run(spark, "sample_hash").sort_values(["row", "col"]).reset_index(drop=True))
