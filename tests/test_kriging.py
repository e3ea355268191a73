"""Variograms against all pairs, kriging against one dense system a gap, and the trend that regression kriging adds."""

import numpy as np
import pytest

from fringeflow.errors import InversionError
from fringeflow.operators import kriging


def field(shape=(40, 50), seed=1, gaps=0.3):
    rng = np.random.default_rng(seed)
    r, c = np.indices(shape)
    z = np.sin(r / 9) * 3 + np.cos(c / 7) * 2 + rng.normal(0, 0.2, shape)
    z[rng.random(shape) < gaps] = np.nan
    return z


def frame(spark, z, more=()):
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows + list(more), "row int, col int, value double")


def test_variogram_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(kriging, "TILE", 16)
    z = field() + 1000
    at = np.argwhere(np.isfinite(z))
    v = z[at[:, 0], at[:, 1]]
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    i, j = np.triu_indices(len(at), 1)
    near = d[i, j] <= 13
    i, j = i[near], j[near]
    lag = np.ceil(d[i, j] * 15 / 13 - 1e-9).astype(int) - 1
    got = {r["lag"]: r for r in kriging.variogram(frame(spark, z), 13).collect()}
    assert set(got) == set(lag)
    for k in got:
        own = lag == k
        assert got[k]["pairs"] == own.sum() and got[k]["distance"] == pytest.approx(d[i, j][own].mean())
        assert got[k]["gamma"] == pytest.approx(((v[i] - v[j])[own] ** 2).mean() / 2, rel=1e-8)


@pytest.mark.parametrize("kind", kriging.MODELS)
def test_fit_finds_its_own_model(kind):
    true = kriging.Variogram(kind, 0.3, 2.0, 20.0)
    h = np.linspace(1, 35, 15)
    got = kriging.fit([(x, 0.3 + 2.0 * float(true.shape(x)), 100) for x in h])
    assert got.kind == kind and (got.nugget, got.sill, got.reach) == pytest.approx((0.3, 2.0, 20.0), rel=1e-3)
    with pytest.raises(InversionError):
        kriging.fit([])


def dense(z, model, k, gap):
    at = np.argwhere(np.isfinite(z))
    d2 = ((at - gap) ** 2).sum(axis=1)
    first = np.lexsort((at[:, 1], at[:, 0], d2))[:k]
    p, v = at[first], z[at[first, 0], at[first, 1]]
    n = len(p)
    gamma = lambda h: np.where(h == 0, 0, model.nugget + model.sill * model.shape(h))
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = gamma(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)))
    a[n, n] = 0
    b = np.append(gamma(np.sqrt(((p - gap) ** 2).sum(axis=1))), 1)
    x = np.linalg.solve(a, b)
    return x[:n] @ v, np.sqrt(max(x @ b, 0)), n


@pytest.mark.parametrize("kind", ["spherical", "exponential"])
def test_kriging_against_dense_systems(spark, monkeypatch, kind):
    monkeypatch.setattr(kriging, "BUCKET", 4)
    model = kriging.Variogram(kind, 0.05, 4.0, 18.0)
    z = field()
    z[5:30, 10:35] = np.nan  # a wide gap: several rounds
    z[20, 20] = 1.0
    got = {(r["row"], r["col"]): r for r in kriging.krige(frame(spark, z), model, 12).collect()}
    assert set(got) == set(map(tuple, np.argwhere(np.isnan(z))))
    for gap in np.argwhere(np.isnan(z))[::7]:
        value, sigma, n = dense(z, model, 12, gap)
        r = got[tuple(gap)]
        assert r["value"] == pytest.approx(value, rel=1e-6) and r["sigma"] == pytest.approx(sigma, rel=1e-5) and r["neighbours"] == n == 12


def test_few_samples_none_and_odd_values(spark):
    model = kriging.Variogram("spherical", 0.0, 1.0, 10.0)
    z = np.full((30, 40), np.nan)
    z[3, 4], z[20, 30] = 1.0, 5.0
    got = kriging.krige(frame(spark, z, [(0, 50, float("nan")), (0, 51, float("inf")), (3, 4, 1.0)]), model, 12).collect()
    assert len(got) == 30 * 40 - 2 + 2 and all(r["neighbours"] == 2 for r in got)
    none = kriging.krige(frame(spark, np.full((3, 3), np.nan)), model).collect()
    assert len(none) == 9 and all(r["value"] is None and r["neighbours"] == 0 for r in none)
    assert kriging.krige(frame(spark, np.ones((3, 3))), model).count() == 0
    flat = kriging.krige(frame(spark, np.where(np.eye(4) > 0, np.nan, 7.0)), kriging.Variogram("spherical", 0, 0, 1)).collect()
    assert all(r["value"] == 7.0 and r["sigma"] == 0 for r in flat)


def test_fill_keeps_what_is_known_and_comes_near(spark):
    truth = field(gaps=0)
    z = np.where(np.random.default_rng(5).random(truth.shape) < 0.3, np.nan, truth)
    out, model = kriging.fill(frame(spark, z), 13)
    rows = out.collect()
    assert len(rows) == z.size and model.sill > 0
    for r in rows:
        if not r["filled"]:
            assert r["value"] == z[r["row"], r["col"]] and r["sigma"] == 0
    error = np.array([r["value"] - truth[r["row"], r["col"]] for r in rows if r["filled"]])
    assert np.sqrt((error**2).mean()) < 0.4


def test_slope_and_regression_kriging(spark):
    shape = (30, 36)
    r, c = np.indices(shape)
    dem = 50 * np.sin(r / 5) + 30 * np.cos(c / 6) + r
    rng = np.random.default_rng(2)
    z = dem / 20 + 0.5 * np.sin((r + c) / 6)
    lost = rng.random(shape) < 0.3
    rows = [(i, j, float(dem[i, j]), None if lost[i, j] else float(z[i, j])) for i in range(shape[0]) for j in range(shape[1])]
    px = kriging.slope(spark.createDataFrame(rows, "row int, col int, height_m double, value double"), shape)
    p = np.pad(dem, 1, mode="edge")
    expected = np.hypot((p[1:-1, 2:] - p[1:-1, :-2]) / 2, (p[2:, 1:-1] - p[:-2, 1:-1]) / 2)
    for x in px.collect():
        assert x["slope"] == pytest.approx(expected[x["row"], x["col"]])
    out, model, score = kriging.regression_fill(px, ["height_m", "slope"], 10, trees=20)
    got = out.collect()
    assert len(got) == z.size and score > 0.8 and model.nugget + model.sill < np.var(z)
    error = np.array([x["value"] - z[x["row"], x["col"]] for x in got if x["filled"]])
    assert len(error) == lost.sum() and np.sqrt((error**2).mean()) < 0.35
