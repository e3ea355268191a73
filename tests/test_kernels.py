"""Numpy kernels against closed formulas, without Spark."""

from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fringeflow.errors import DimensionMismatch, InvalidNetwork, MetadataError, RasterError, UnsupportedFormat
from fringeflow.operators import kernels as K
from fringeflow.operators import network as N
from fringeflow.operators.cube import Meta, Pair, check_pairs, every
from fringeflow.operators.features import FeatureConfig, describe, names
from fringeflow.operators.inversion import dem_error_column, temporal_design
from fringeflow.sources import geotiff, isce

PAIRS = (Pair(0, 1), Pair(1, 2), Pair(2, 3), Pair(0, 2), Pair(1, 3))
FULL = tuple(Pair(i, j) for i in range(4) for j in range(i + 1, 4))


def phases(d, pairs):
    return np.array([[x[p.sec] - x[p.ref] for p in pairs] for x in d])


def test_round_away_from_zero():
    assert K.round_away(np.array([0.5, 1.5, 2.5, -0.5, -2.5, 0.4])).tolist() == [1, 2, 3, -1, -3, 0]


@given(st.floats(-100, 100))
def test_wrap_diff_is_congruent(d):
    w = float(K.wrap_diff(d))
    assert -np.pi < w <= np.pi + 1e-9
    assert abs((w - d) / (2 * np.pi) - round((w - d) / (2 * np.pi))) < 1e-9


def test_network_of_four_epochs():
    got = N.build_network(every(date(2020, 1, 1), 12, 4), [0, 50, -30, 100], 25, 200)
    assert [(p.ref, p.sec, p.perp_baseline_m) for p in got] == [(0, 1, 50), (0, 2, -30), (1, 2, -80), (1, 3, 50), (2, 3, 130)]


@pytest.mark.parametrize("epochs, perp", [
    ((date(2020, 1, 1), date(2020, 1, 13), date(2020, 4, 10), date(2020, 4, 22)), [0, 0, 0, 0]),
    ((date(2020, 1, 1),), [0, 0]),
    ((date(2020, 1, 2), date(2020, 1, 1)), [0, 0]),
    ((), []),
])
def test_bad_networks(epochs, perp):
    with pytest.raises(InvalidNetwork):
        N.build_network(epochs, perp, 25, 200)


def test_pairs_are_checked():
    for bad in ([Pair(0, 0)], [Pair(1, 0)], [Pair(0, 9)], [Pair(0, 1), Pair(0, 1)]):
        with pytest.raises(InvalidNetwork):
            check_pairs(bad, 3)
    with pytest.raises(DimensionMismatch):
        check_pairs([Pair(0, 1)], 3, 2)


def test_connectivity():
    assert N.is_connected((), 0) and N.is_connected(PAIRS, 4)
    assert not N.is_connected(PAIRS, 5) and not N.is_connected([Pair(0, 7)], 3)
    epochs, pairs, at = N.largest_component([Pair(0, 1), Pair(2, 3), Pair(3, 4)], every(date(2020, 1, 1), 1, 5))
    assert len(epochs) == 3 and [(p.ref, p.sec) for p in pairs] == [(0, 1), (1, 2)] and at == [1, 2]


def test_loops_of_a_triangle():
    assert N.loop_matrix((Pair(0, 1), Pair(1, 2), Pair(0, 2))).tolist() == [[1, 1, -1]]


def test_ols_with_gaps():
    rng = np.random.default_rng(1)
    d = np.hstack([np.zeros((40, 1)), np.cumsum(rng.normal(size=(40, 3)), axis=1)])
    b = phases(d, PAIRS)
    b[3, 3] = np.nan  # a redundant pair
    b[5, [2, 4]] = np.nan  # the last epoch is cut off
    b[7] = np.nan
    b[10:30, 0] = np.nan  # a common pattern, solved once
    design = N.design_matrix(PAIRS, 4)
    x = K.ols(b, design, PAIRS, 4, np.linalg.pinv(design))
    bad = [5, 7]
    assert np.isnan(x[bad]).all()
    good = [i for i in range(40) if i not in bad]
    assert np.allclose(np.cumsum(x[good], axis=1), d[good, 1:], atol=1e-9)


def test_weights_and_robust_solve_resist_an_outlier():
    d = np.array([[0, 1.0, 2.0, 3.0]])
    b = phases(d, FULL)
    b[0, 2] += 3  # the pair (0, 3)
    design = N.design_matrix(FULL, 4)
    ols = np.cumsum(K.ols(b, design, FULL, 4, np.linalg.pinv(design)), axis=1)
    l1 = np.cumsum(K.robust(b, np.ones_like(b), design, FULL, 4), axis=1)
    assert np.abs(l1 - d[:, 1:]).max() < np.abs(ols - d[:, 1:]).max() / 10
    w = np.where(np.arange(6) == 2, 0.05, 0.95)[None]
    wls = np.cumsum(K.weighted_checked(b, w, design, FULL, 4), axis=1)
    assert np.abs(wls - d[:, 1:]).max() < np.abs(ols - d[:, 1:]).max() / 5
    w[0, 2] = np.nan
    assert np.allclose(np.cumsum(K.weighted_checked(b, w, design, FULL, 4), axis=1), d[:, 1:])


def test_dem_error_and_collinear_column():
    pairs = tuple(Pair(p.ref, p.sec, x) for p, x in zip(PAIRS, [50, -30, 80, -20, 60], strict=True))
    g = dem_error_column(pairs, 850e3, 39.0)
    scale = np.linalg.norm(g)
    design = np.hstack([N.design_matrix(pairs, 4), (g / scale)[:, None]])
    b = phases(np.array([[0, 0.01, 0.02, 0.05]]), pairs) + 30 * g
    x = K.weighted_checked(b, np.ones_like(b), design, pairs, 4)
    assert abs(x[0, -1] / scale - 30) < 0.05
    flat = np.hstack([N.design_matrix(pairs, 4), N.design_matrix(pairs, 4).sum(axis=1, keepdims=True)])
    assert np.isnan(K.weighted_checked(b, np.ones_like(b), flat, pairs, 4)).all()
    for bad in ((-1, 39), (np.inf, 39), (850e3, 0), (850e3, 90)):
        with pytest.raises(MetadataError):
            dem_error_column(pairs, *bad)
    with pytest.raises(MetadataError):
        dem_error_column(PAIRS, 850e3, 39)


def test_closure_correction():
    d = np.tile([0, 1, 1.7, 2.4], (6, 1))
    f = phases(d, FULL)
    f[0, 0] += 2 * np.pi
    f[5, 0] += 2 * np.pi
    out, done, left = K.correct_closure(f, N.loop_matrix(FULL))
    assert done.sum() == 2 and not left.any() and np.allclose(out, phases(d, FULL))
    triangle = (Pair(0, 1), Pair(1, 2), Pair(0, 2))
    g = phases(d[:, :3], triangle)
    g[0, 0] += 2 * np.pi
    out, done, left = K.correct_closure(g, N.loop_matrix(triangle))
    assert left[0] and not done.any() and np.array_equal(out, g)
    g[1, 1] = np.nan
    assert K.correct_closure(g, N.loop_matrix(triangle))[2].sum() == 1


def test_bootstrap_is_deterministic_and_near_the_formal_error():
    t = np.arange(12) / 12
    noise = np.random.default_rng(3).normal(scale=0.002, size=(4, 12))
    d = 0.05 * t + noise
    seeds = K.pixel_seeds(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), 42)
    a, b = K.bootstrap_slopes(d, t, seeds, 200), K.bootstrap_slopes(d, t, seeds, 200)
    c = t - t.mean()
    r = d - d.mean(axis=1, keepdims=True) - np.outer(d @ c / (c @ c), c)
    formal = np.sqrt((r * r).sum(axis=1) / 10 / (c @ c))
    assert np.array_equal(a, b) and ((a / formal > 1 / 3) & (a / formal < 3)).all()


def test_splitmix_first_number():
    _, z = K.splitmix(np.array([0], np.uint64))
    assert int(z[0]) == 0xE220A8397B1DCDAF


@pytest.mark.parametrize("window", [3, 5, 99])
def test_high_pass_leaves_nothing_of_a_line(window):
    t = np.array([0, 12, 24, 36, 156, 168, 180, 192, 204]) / 365.25
    assert np.abs(K.high_pass_matrix(t, window) @ (3 * t - 1)).max() < 1e-12


def test_low_pass():
    x = np.full((12, 9), 5.0)
    x[3, 4] = np.nan
    y = K.low_pass(x, 2.0)
    assert np.isnan(y[3, 4]) and np.allclose(y[np.isfinite(y)], 5)


def test_unwrap_ramp_islands_seed_and_quality():
    r, c = np.indices((24, 20))
    truth = 0.45 * r + 0.35 * c
    got = K.unwrap(np.angle(np.exp(1j * truth)))
    assert np.allclose(got - got[0, 0], truth, atol=1e-4) and got[12, 10] == pytest.approx(np.angle(np.exp(1j * truth[12, 10])))
    w = np.angle(np.exp(1j * truth))
    w[:, 9:11] = np.nan
    got = K.unwrap(w)
    for part in (slice(0, 9), slice(11, 20)):
        k = (got - truth)[:, part] / (2 * np.pi)
        assert np.ptp(k) < 1e-4
    q = np.full((24, 20), 0.3)
    q[2, 3] = 5
    got = K.unwrap(np.angle(np.exp(1j * truth)), q)
    assert got[2, 3] == pytest.approx(np.angle(np.exp(1j * truth[2, 3])))
    q[:, 7] = 0.1
    got = K.unwrap(np.angle(np.exp(1j * truth)), q, 0.2)
    assert np.isnan(got[:, 7]).all() and np.isfinite(got[:, :7]).all()
    assert np.isnan(K.unwrap(np.full((3, 3), np.nan))).all()


def test_temporal_design_names_and_errors():
    epochs = every(date(2020, 1, 1), 12, 40)
    _, got = temporal_design(epochs, 2, (1.0, 0.5), (epochs[20],))
    assert got == ["offset", "velocity", "poly2", "cos_1yr", "sin_1yr", "cos_0.5yr", "sin_0.5yr", f"step_{epochs[20]:%Y%m%d}"]
    for kw in ({"order": 0}, {"periods": (0.0,)}, {"steps": (epochs[0],)}, {"order": 40}):
        with pytest.raises(RuntimeError):
            temporal_design(epochs, **kw)


def test_features_of_known_series():
    t = np.arange(40) * 30 / 365.25
    got = describe(np.array([0.03 * np.sin(2 * np.pi * t), 0.5 * 0.08 * t * t, np.full(40, np.nan)]), t, FeatureConfig())
    assert got["seasonal_amplitude"][0] == pytest.approx(0.03, abs=1e-3) and got["acceleration"][1] == pytest.approx(0.08, abs=1e-3)
    assert all(np.isnan(v[2]) for v in got.values()) and list(got) == names(FeatureConfig())
    t = np.arange(12) * 24 / 365.25
    d = -0.05 * t
    d[[3, 7]] = np.nan
    got = describe(d[None], t, FeatureConfig(False, False))
    assert got["velocity"][0] == pytest.approx(-0.05, abs=1e-5) and got["linearity_r2"][0] == pytest.approx(1)


@settings(max_examples=20)
@given(st.integers(1, 7), st.integers(1, 7), st.sampled_from([None, "EPSG:32719"]))
def test_geotiff_round_trip(rows, cols, crs):
    grid = np.arange(rows * cols, dtype=np.float32).reshape(rows, cols) * 100
    grid[0, 0] = np.nan
    back, meta = geotiff.decode(geotiff.encode(grid, Meta((500.0, 7000.0, 30.0, -30.0), crs)))
    assert np.array_equal(back, grid, equal_nan=True) and meta.transform == (500.0, 7000.0, 30.0, -30.0) and meta.crs == crs


def test_damaged_geotiff():
    data = geotiff.encode(np.ones((4, 5)), Meta())
    for bad in (data[:-8], data[:20], b"XX" + data[2:]):
        with pytest.raises(RasterError):
            geotiff.decode(bad)


VRT = """<VRTDataset rasterXSize="4" rasterYSize="3">
<VRTRasterBand dataType="Float32" band="2" subClass="VRTRawRasterBand"><SourceFilename relativeToVRT="1">x</SourceFilename><ByteOrder>{order}</ByteOrder><ImageOffset>16</ImageOffset><PixelOffset>4</PixelOffset><LineOffset>32</LineOffset></VRTRasterBand>
<VRTRasterBand dataType="Float32" band="{first}" subClass="VRTRawRasterBand"><SourceFilename relativeToVRT="1">x</SourceFilename><ByteOrder>{order}</ByteOrder><ImageOffset>0</ImageOffset><PixelOffset>4</PixelOffset><LineOffset>32</LineOffset></VRTRasterBand>
</VRTDataset>"""


@pytest.mark.parametrize("order, code", [("LSB", "<f4"), ("MSB", ">f4")])
def test_vrt_bands_by_number(order, code):
    layout = isce.parse_vrt(VRT.format(order=order, first=1))
    r, c = np.indices((3, 4))
    b1 = 10.0 * r + c
    data = np.stack([b1, b1 + 0.5], axis=1).astype(code).tobytes()
    assert np.array_equal(isce.read_band(data, layout, 1), b1) and np.array_equal(isce.read_band(data, layout, 2), b1 + 0.5)
    with pytest.raises(RasterError):
        isce.read_band(data[:-1], layout, 2)
    with pytest.raises(MetadataError):
        isce.read_band(data, layout, 3)
    with pytest.raises(UnsupportedFormat):
        isce.read_band(data, layout, 1, kinds=("c8",))


def test_bad_vrt():
    for text in ("<x", VRT.format(order="LSB", first=3), VRT.format(order="PDP", first=1)):
        with pytest.raises(MetadataError):
            isce.parse_vrt(text)


def test_dispersion_of_arrays_as_of_long_rows(spark):
    from pyspark.sql import functions as F

    from fringeflow.operators.ps import amplitude_dispersion, dispersion_of_arrays

    rng = np.random.default_rng(4)
    rows = [(r, 0, rng.random(6).tolist()) for r in range(20)] + [(20, 0, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (21, 0, [1.0, float("nan")] * 3), (22, 0, [1.0, float("inf")] * 3), (23, 0, [0.0] * 6), (24, 0, None), (25, 0, [-1.0, 1.0] * 3)]
    px = spark.createDataFrame(rows, "row int, col int, amplitude array<double>")
    long = px.select("row", "col", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(5)).alias("e"), "amplitude")).alias("x")).select("row", "col", F.col("x.e").alias("epoch_idx"), "x.amplitude")
    want = {r["row"]: r["amp_dispersion"] for r in amplitude_dispersion(long, 6).collect()}
    got = {r["row"]: r["amp_dispersion"] for r in dispersion_of_arrays(px, 6).collect()}
    assert set(got) == set(range(26)) and all(got[k] is None if want.get(k) is None else got[k] == pytest.approx(want[k]) for k in got)
