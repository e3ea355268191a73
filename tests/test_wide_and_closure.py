"""Wide pairs beside the band, and closure corrections of many patterns at once, against one solve a row."""

import time

import numpy as np
import pytest

from fringeflow.operators import kernels
from fringeflow.operators.cube import Pair
from fringeflow.operators.network import design_matrix, loop_matrix


def network(n, wide=()):
    return tuple(Pair(i, i + k) for k in (1, 2, 3) for i in range(n - k)) + tuple(Pair(*p) for p in wide)


def lossy(n, pairs, rows, seed, share=0.2):
    rng = np.random.default_rng(seed)
    b = np.cumsum(rng.normal(size=(rows, n)), axis=1)
    obs = np.stack([b[:, p.sec] - b[:, p.ref] for p in pairs], axis=1) + rng.normal(0, 0.1, (rows, len(pairs)))
    obs[rng.random(obs.shape) < share] = np.nan
    return obs


@pytest.mark.parametrize("wide", [[(0, 17)], [(0, 29), (3, 25), (5, 28)], [(i, i + 18) for i in range(12)]])
def test_wide_pairs_against_a_solve_a_row(wide):
    n = 30
    pairs = network(n, wide)
    obs, design = lossy(n, pairs, 60, 1), design_matrix(pairs, n)
    got = kernels.ols(obs, design, pairs, n, kernels.full_rank_pinv(design))
    for x, o in zip(got, obs, strict=True):
        m = np.isfinite(o)
        p = kernels.full_rank_pinv(design[m])
        if p is None:
            assert np.isnan(x).all()
        else:
            assert np.allclose(x, p @ o[m], atol=1e-9)


def test_rows_that_only_wide_pairs_connect():
    n = 24
    pairs = tuple(Pair(i, i + 1) for i in range(n - 1)) + (Pair(0, 20), Pair(2, 22))
    obs, design = lossy(n, pairs, 12, 2, 0.0), design_matrix(pairs, n)
    for k in range(12):
        obs[k, k + 5] = np.nan  # the chain is broken; a wide pair bridges it
    got = kernels.ols(obs, design, pairs, n, kernels.full_rank_pinv(design))
    for x, o in zip(got, obs, strict=True):
        m = np.isfinite(o)
        assert np.allclose(x, np.linalg.lstsq(design[m], o[m], rcond=None)[0], atol=1e-8)


def test_a_wide_pair_costs_little():
    n = 98
    took = []
    for wide in ([], [(0, 60)]):
        pairs = network(n, wide)
        obs, design = lossy(n, pairs, 400, 3), design_matrix(pairs, n)
        p = kernels.full_rank_pinv(design)
        kernels.ols(obs, design, pairs, n, p)
        best = min(_timed(lambda: kernels.ols(obs, design, pairs, n, p)) for _ in range(3))  # noqa: B023
        took.append(best)
    assert took[1] < 6 * took[0]


def _timed(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def slowly(phase, loops):
    """One pseudo-inverse a row."""
    out, done, left = phase.copy(), np.zeros(len(phase), bool), np.zeros(len(phase), bool)
    fractions = []
    for k, f in enumerate(phase):
        m = ~((~np.isfinite(f)).astype(float) @ np.abs(loops).T > 0)
        n = kernels.round_away(np.nan_to_num(f) @ loops[m].T / (2 * np.pi))
        if not np.abs(n).sum():
            continue
        u = np.linalg.pinv(loops[m]) @ n
        fractions.append(np.abs(np.abs(u - np.trunc(u)) - 0.5).min())
        u = kernels.round_away(np.where(np.abs(np.abs(u - np.trunc(u)) - 0.5) < 1e-6, np.trunc(u) + 0.5 * np.sign(u), u))
        better = np.abs(n - loops[m] @ u).sum() < np.abs(n).sum()
        done[k], left[k] = better, not better
        if better:
            out[k] -= 2 * np.pi * u
    return out, done, left


def test_closure_of_many_patterns():
    n = 20
    pairs = network(n)
    loops = loop_matrix(pairs)
    rng = np.random.default_rng(5)
    phase = lossy(n, pairs, 300, 6, 0.0)
    jumps = (rng.random(phase.shape) < 0.05) * rng.integers(-2, 3, phase.shape)
    phase = phase + 2 * np.pi * jumps
    phase[rng.random(phase.shape) < 0.1] = np.nan
    phase[:40] = np.where(np.arange(len(pairs)) == 7, np.nan, phase[0])  # a frequent pattern
    got, want = kernels.correct_closure(phase, loops), slowly(phase, loops)
    assert np.allclose(got[0], want[0], atol=1e-9, equal_nan=True)
    assert (got[1] == want[1]).all() and (got[2] == want[2]).all() and got[1].sum() > 100 and got[2].any()


def test_least_norm_of_deficient_rows():
    loops = loop_matrix(network(15))
    rng = np.random.default_rng(7)
    active = rng.random((80, len(loops))) < 0.6
    right = rng.integers(-2, 3, (80, len(loops))).astype(float)
    got = kernels.least_norm(loops, active, right)
    for x, m, r in zip(got, active, right, strict=True):
        assert np.allclose(x, np.linalg.pinv(loops[m]) @ r[m], atol=1e-9)
    assert kernels.least_norm(loops, active[:0], right[:0]).shape == (0, loops.shape[1])
