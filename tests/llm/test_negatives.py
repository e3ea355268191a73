"""Hard negatives against brute force, over several tiles, chunks and panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.llm import negatives


def brute(rows, anchor):
    """rows: (id, label, vector) in the order of their ids."""
    dim = max([len(v) for _, _, v in rows], default=0)
    q = np.array([[int(np.floor(256 * x)) for x in v] + [0] * (dim - len(v)) for _, _, v in rows], dtype=object).reshape(len(rows), dim)
    out = []
    for a, (i, label, _) in enumerate(rows):
        if not anchor(i):
            continue
        scores = [int(sum(q[a] * q[b])) for b in range(len(rows))]
        order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-scores[b], rows[b][0], b))
        for p in [b for b in order if rows[b][1] == label][:5]:
            fits = [b for b in order if rows[b][1] != label and 50 * scores[p] <= 100 * scores[b] <= 95 * scores[p]]
            out += [(i, rows[p][0], k + 1, rows[b][0], scores[p], scores[b]) for k, b in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows, kind="array<float>", **kw):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding {kind}").withColumns({"j": F.lit(1), "at": F.lit("x"), "score": F.lit(0)})
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 3 == 0, **kw).collect())


@pytest.fixture
def small(monkeypatch):
    for name, n in (("ANCHORS", 8), ("ROWS", 16), ("CHUNK", 4)):
        monkeypatch.setattr(negatives, name, n)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    mids = rng.standard_normal((5, dim))
    return [(int(i), int(c := rng.integers(5)), [float(np.float32(x)) for x in mids[c] * 0.4 + rng.standard_normal(dim) * 0.6]) for i in range(n)]


def test_blocks_chunks_and_panels_against_brute_force(spark, small):
    rows = clustered(90, 11, 1)
    expected = brute(rows, lambda i: i % 3 == 0)
    assert len(expected) > 100
    assert mined(spark, rows, panel=2) == expected


def test_ties_and_skew(spark, small):
    rows = [(i, 0 if i % 3 else i % 4, [1.0, 0.5 if i % 2 else 0.9, 0.0]) for i in range(60)]  # few scores, most rows of one label
    expected = brute(rows, lambda i: i % 3 == 0)
    assert expected and mined(spark, rows) == expected


def test_rows_that_take_no_part_and_odd_lengths(spark, small):
    rows = clustered(40, 6, 2)
    odd = [(100, None, [1.0] * 6), (101, 1, None), (102, 1, [1.0, None]), (103, 1, [float("nan")]), (104, 1, [float("inf")]), (None, 1, [1.0] * 6)]
    ragged = [(105, 1, []), (106, 1, [0.5, 0.5]), (108, 2, [0.4] * 9)]
    assert mined(spark, rows + odd + ragged) == brute(rows + ragged, lambda i: i % 3 == 0)


def test_repeated_ids_are_rows_of_their_own(spark, small):
    rows = sorted(clustered(20, 4, 3) + clustered(20, 4, 3))
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_large_components_stay_exact(spark, small):
    rows = [(i, i % 2, [float(2**22 + i * 7919), 1.0 - i]) for i in range(30)]
    assert mined(spark, rows, "array<double>") == brute(rows, lambda i: i % 3 == 0)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(3, 1, [1e30]), (4, 1, [1e30])], "array<double>")


def test_empty_table_and_no_anchors(spark, small):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 0, [1.0])]) == []


def test_best_takes_ties_by_place():
    s = np.array([5, 9, 9, negatives._OUT, 9, 1] * 8)
    assert negatives.best(s, 4).tolist() == [1, 2, 4, 7]
    assert negatives.best(s[:4], 3).tolist() == [1, 2, 0]
