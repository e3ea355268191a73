"""Embedding near-dedup: collision counts against a plain count, and recall over several cells at production parameters."""

import numpy as np

from fringeflow.llm import embed
from fringeflow.llm.simhash import merge_labels


def test_collisions_against_a_plain_count():
    rng = np.random.default_rng(0)
    for n, m, least in ((130, 70, 5), (1, 3, 1), (64, 64, 8), (200, 1, 3)):
        b, q = rng.normal(size=(n, 8)).round(1), rng.normal(size=(m, 8)).round(1)
        i, j = embed.collisions(b, q, 0.55, least)
        want = np.argwhere((np.abs(q[:, None] - b[None]) <= 0.55).sum(axis=2) >= least)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def planted(n, dim, seed, groups, low=0.95):
    """n unit vectors, of which `groups` have a partner at a cosine spread over low .. 1, a third of them just above low."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = np.where(np.arange(groups) % 3 == 0, low + 0.0005, rng.uniform(low, 1, groups))
    side = rng.normal(size=(groups, dim))
    side -= np.einsum("ij,ij->i", side, x[:groups])[:, None] * x[:groups]
    side /= np.linalg.norm(side, axis=1)[:, None]
    return np.vstack([x, cos[:, None] * x[:groups] + np.sqrt(1 - cos**2)[:, None] * side])


def run(spark, v):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    return {r["vec_id"]: r for r in embed.near_duplicates(df).collect()}


def links_of(v):
    out = []
    for s in range(0, len(v), 1000):
        q, b = np.nonzero(v[s : s + 1000] @ v.T >= 0.95)
        out.append(np.stack([q + s, b], axis=1))
    pairs = np.concatenate(out)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def test_recall_over_many_cells(spark):
    v = planted(16_000, 32, 1, 3000)
    tours = embed.plan_tours(v[:5000], len(v), 0.95)
    assert len(tours) > 1 and all(len(places) >= 3 for _, places in tours)  # several cells at the production BLOCK
    got, pairs = run(spark, v), links_of(v)
    links = np.array([got[i]["n_links"] for i in range(len(v))])
    want = np.bincount(pairs[:, 0], minlength=len(v))
    assert (links <= want).all() and links.sum() >= 0.97 * want.sum()
    at_edge = np.arange(0, 3000, 3)
    assert links[at_edge].sum() >= 0.95 * want[at_edge].sum()


def test_a_full_cell_is_split_and_loses_nothing(spark, monkeypatch):
    """One tight group larger than two blocks: no cut parts it, and each vector links with all others."""
    monkeypatch.setattr(embed, "BLOCK", 50)
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(size=(200, 16)), np.ones(16) + rng.normal(scale=0.01, size=(400, 16))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    got, pairs = run(spark, v), links_of(v)
    want, label = np.bincount(pairs[:, 0], minlength=len(v)), np.arange(len(v))
    merge_labels(label, pairs[:, 0], pairs[:, 1])
    assert sum(got[i]["n_links"] for i in range(len(v))) >= 0.98 * want.sum()
    assert all(got[i]["component_id"] == label[i] for i in range(200, 600))
    assert all(got[i]["n_links"] <= want[i] for i in range(len(v)))
