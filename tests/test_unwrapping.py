"""Unwrapping in tiles against one fill over the whole layer."""

from itertools import product

import numpy as np
import pytest

from fringeflow.operators import kernels, unwrapping

TWO_PI = 2 * np.pi


def run(spark, layers, quality=None, least=None, tile=8):
    rows = [(r, c, k, None if np.isnan(w[r, c]) else float(w[r, c]), None if q is None or np.isnan(q[r, c]) else float(q[r, c])) for k, (w, q) in enumerate(layers) for r in range(w.shape[0]) for c in range(w.shape[1])]
    df = spark.createDataFrame(rows, "row int, col int, pair_idx int, wrapped double, coh double")
    got = unwrapping.unwrap_stack(df, layers[0][0].shape, quality, least, tile).collect()
    assert len(got) == len(rows)
    out = [np.full(w.shape, np.nan) for w, _ in layers]
    for r in got:
        if r["phase"] is not None:
            out[r["pair_idx"]][r["row"], r["col"]] = r["phase"]
    return out


def wrap(x):
    return np.arctan2(np.sin(x), np.cos(x))


def surface(shape, seed):
    rng = np.random.default_rng(seed)
    r, c = np.indices(shape)
    return 0.45 * r - 0.35 * c + 4 * np.exp(-((r - shape[0] / 3) ** 2 + (c - shape[1] / 2) ** 2) / 60) + rng.normal(0, 0.2, shape)


@pytest.mark.parametrize("fan", [2, 8])
def test_tiles_give_the_whole_layers_fill(spark, monkeypatch, fan):
    monkeypatch.setattr(unwrapping, "FAN", fan)
    layers = []
    for k, shape in enumerate([(45, 38)] * 2):
        w = wrap(surface(shape, k))
        q = np.random.default_rng(k + 9).random(shape)
        w[:, 20:22] = np.nan  # two sides that do not meet, and a hole with a speck
        w[30:36, 2:9] = np.nan
        w[33, 5] = 1.0
        layers.append((w, q))
    for quality in (None, "coh"):
        got = run(spark, layers, quality)
        for (w, q), g in zip(layers, got, strict=True):
            assert np.allclose(g, kernels.unwrap(w, q if quality else None), atol=1e-9, equal_nan=True)


def test_least_quality_and_rings(spark):
    shape = (40, 40)
    w = wrap(surface(shape, 3))
    q = np.full(shape, 0.9)
    q[10, 10:30] = q[29, 10:30] = q[10:30, 10] = q[10:30, 29] = 0.1  # a closed wall: inside and outside are apart
    q[5, 5] = q[20, 20] = 0.95
    got, = run(spark, [(w, q)], "coh", 0.3)
    assert np.allclose(got, kernels.unwrap(w, q, 0.3), atol=1e-9, equal_nan=True)
    assert np.isnan(got[10, 15]) and got[20, 20] == pytest.approx(w[20, 20]) and got[5, 5] == pytest.approx(w[5, 5])


def test_residues_leave_whole_cycles(spark):
    shape = (34, 34)
    rng = np.random.default_rng(8)
    w = wrap(surface(shape, 5) + rng.normal(0, 0.9, shape))
    got, = run(spark, [(w, None)])
    turns = (got - w) / TWO_PI
    assert np.allclose(turns, np.round(turns), atol=1e-9)
    assert got[17, 17] == pytest.approx(w[17, 17])


def test_strongest_seams_join_first(spark):
    """Between two tiles most of the seam says none, a part of low quality says a cycle."""
    w, q = np.zeros((8, 16)), np.full((8, 16), 0.9)
    true = np.zeros((8, 16))
    true[:, 8:] = 3.0
    true[0:3, 8:] = 3.4
    w = wrap(true)
    q[0:3] = 0.1
    got, = run(spark, [(w, q)], "coh")
    assert np.allclose(got[3:], true[3:], atol=1e-9)


def test_one_tile_and_no_rows(spark):
    w = wrap(surface((6, 7), 1))
    got, = run(spark, [(w, None)], tile=8)
    assert np.allclose(got, kernels.unwrap(w), atol=1e-12)
    none = spark.createDataFrame([], "row int, col int, pair_idx int, wrapped double")
    assert unwrapping.unwrap_stack(none, (40, 40), tile=8).count() == 0


def cost_of(w, t, q):
    total = 0
    for a, b in [((r, c), (r + dr, c + dc)) for r in range(w.shape[0]) for c in range(w.shape[1]) for dr, dc in ((0, 1), (1, 0)) if r + dr < w.shape[0] and c + dc < w.shape[1]]:
        if np.isfinite(w[a]) and np.isfinite(w[b]):
            k = -np.ceil((w[b] - w[a] - np.pi) / TWO_PI)
            total += min(q[a], q[b]) * abs(t[b] - t[a] - k)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_turns_of_least_cost_against_all_turns(seed):
    rng = np.random.default_rng(seed)
    w = rng.uniform(-np.pi, np.pi, (3, 3))
    if seed % 2:
        w[1, 1] = np.nan
    q = rng.integers(1, 20, w.shape)
    got = kernels.cheapest_turns(w, np.zeros(w.shape, int), q)
    cells = [i for i in range(9) if np.isfinite(w.flat[i])]
    least = min(cost_of(w, t.reshape(3, 3), q) for x in product((-1, 0, 1), repeat=len(cells) - 1) for t in [np.zeros(9)] if not t.__setitem__(cells[1:], x))
    assert cost_of(w, got, q) == least


def test_cost_finds_the_cycles_where_the_fill_does_not(spark):
    """A steep noisy patch of low quality: a fill that goes through it leaves a torn region, the cheapest turns do not."""
    shape = (40, 40)
    r, c = np.indices(shape)
    rng = np.random.default_rng(12)
    true = 0.35 * r + 0.2 * c
    noisy = (abs(r - 20) < 6) & (abs(c - 20) < 6)
    seen = true + np.where(noisy, rng.normal(0, 1.3, shape), rng.normal(0, 0.05, shape))
    w = wrap(seen)
    costs = {}
    for method in ("fill", "cost"):
        rows = [(i, j, 0, float(w[i, j])) for i in range(40) for j in range(40)]
        df = spark.createDataFrame(rows, "row int, col int, pair_idx int, wrapped double")
        out = np.full(shape, np.nan)
        for x in unwrapping.unwrap_stack(df, shape, method=method).collect():
            out[x["row"], x["col"]] = x["phase"]
        t = np.round((out - w) / TWO_PI)
        assert np.allclose(out, w + TWO_PI * t, atol=1e-9)
        costs[method] = cost_of(w, t, np.ones(shape))
        if method == "cost":
            apart = np.round((out - seen) / TWO_PI)
            assert len(set(apart[~noisy].tolist())) == 1
    assert costs["cost"] < costs["fill"]


def test_cost_without_residues_is_the_fill(spark):
    w = wrap(surface((40, 38), 3))
    q = np.random.default_rng(9).random(w.shape)
    rows = [(i, j, 0, float(w[i, j]), float(q[i, j])) for i in range(40) for j in range(38)]
    df = spark.createDataFrame(rows, "row int, col int, pair_idx int, wrapped double, coh double")
    a, b = ({(x["row"], x["col"]): x["phase"] for x in unwrapping.unwrap_stack(df, w.shape, "coh", tile=16, method=m).collect()} for m in ("fill", "cost"))
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
