"""Random gaps in every pixel: batched connectivity, banded solves and features against the plain way, pixel by pixel."""

import time

import numpy as np
import pytest

from fringeflow.operators import kernels
from fringeflow.operators.cube import Pair
from fringeflow.operators.features import FeatureConfig, _design, describe
from fringeflow.operators.network import components, design_matrix


def network(n, span):
    return tuple(Pair(i, j) for i in range(n) for j in range(i + 1, min(n, i + span + 1)))


def plain(b, design, pairs, n):
    out = np.full((len(b), design.shape[1]), np.nan)
    for r, row in enumerate(b):
        ok = np.isfinite(row)
        kept = [p for p, m in zip(pairs, ok, strict=True) if m]
        if len(kept) >= design.shape[1] and len(set(components(kept, n))) == 1:
            out[r] = np.linalg.lstsq(design[ok], row[ok], rcond=None)[0]
    return out


@pytest.mark.parametrize("n, span, share", [(8, 3, 0.3), (12, 2, 0.2), (6, 5, 0.5), (20, 19, 0.6), (2, 1, 0.3)])
def test_gappy_rows_against_pixel_by_pixel(n, span, share):
    rng = np.random.default_rng(n)
    pairs, b = network(n, span), rng.normal(size=(400, len(network(n, span))))
    b[rng.random(b.shape) < share] = np.nan
    b[:20] = b[20]  # a pattern that is not rare
    design = design_matrix(pairs, n)
    got = kernels.ols(b, design, pairs, n, np.linalg.pinv(design))
    want = plain(b, design, pairs, n)
    assert np.array_equal(np.isnan(got), np.isnan(want)) and np.allclose(got, want, atol=1e-8, equal_nan=True)
    good = kernels.solvable(np.isfinite(b), pairs, n, n - 1)
    assert np.array_equal(good, np.isfinite(want).all(axis=1)) and (n == 2 or 0 < good.sum())


def test_the_published_size_takes_linear_time():
    rng = np.random.default_rng(0)
    pairs = tuple(Pair(i, i + k) for k in (1, 2, 3) for i in range(98 - k))
    b = rng.normal(size=(4000, len(pairs)))
    b[rng.random(b.shape) < 0.2] = np.nan
    design = design_matrix(pairs, 98)
    pinv = np.linalg.pinv(design)
    began = time.process_time()
    kernels.ols(b, design, pairs, 98, pinv)
    assert time.process_time() - began < 2


@pytest.mark.parametrize("config", [FeatureConfig(), FeatureConfig(seasonal=False), FeatureConfig(acceleration=False, seasonal=False, min_valid=2)])
def test_features_with_gaps_against_row_by_row(config):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 3, 14))
    d = rng.normal(size=(300, 14))
    d[rng.random(d.shape) < 0.4] = np.nan
    d[0], d[1], d[2, 1:] = np.nan, 1.0, np.nan
    got, g = describe(d, t, config), _design(t, config)
    for r, row in enumerate(d):
        ok = np.isfinite(row)
        if ok.sum() < max(config.min_valid, g.shape[1]):
            assert all(np.isnan(v[r]) for v in got.values())
            continue
        c, y = np.linalg.lstsq(g[ok], row[ok], rcond=None)[0], row[ok]
        res, q = y - g[ok] @ c, ok.sum()
        assert got["velocity"][r] == pytest.approx(c[1], abs=1e-7) and got["residual_rms"][r] == pytest.approx(np.sqrt(res @ res / q), abs=1e-7)
        if q > g.shape[1]:
            assert got["velocity_std"][r] == pytest.approx(np.sqrt(res @ res / (q - g.shape[1]) * np.linalg.inv(g[ok].T @ g[ok])[1, 1]), rel=1e-4, abs=1e-9)
        assert got["cumulative"][r] == pytest.approx(y[-1] - y[0]) and got["max_step"][r] == pytest.approx(np.abs(np.diff(y)).max() if q > 1 else 0)
    assert describe(d[:0], t, config)["velocity"].shape == (0,)
