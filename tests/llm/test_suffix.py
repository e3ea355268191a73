"""Hot grams: byte for byte, also where polynomial hashes modulo 2**64 collide, and nothing is left behind."""

import numpy as np
from fringeflow.llm import suffix


def thue_morse(k):
    x = np.zeros(1, np.uint8)
    for _ in range(k):
        x = np.r_[x, 1 - x]
    return bytes(b"ab"[v] for v in x)


def covered(rows, width):
    seen, out = set(), {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            w = t[p : p + width]
            if w in seen:
                gone[p : p + width] = True
            seen.add(w)
        out[i] = int(gone.sum())
    return out


def test_hot_windows_are_compared_byte_for_byte(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 4)
    monkeypatch.setattr(suffix, "HOT_TASK", 2)
    monkeypatch.setattr(suffix, "HELD", 300)
    flip = bytes.maketrans(b"ab", b"ba")
    long = thue_morse(12)
    rng = np.random.default_rng(0)
    rows = [(0, long), (1, long.translate(flip)), (2, b"x" * 350 + long[:700]), (3, b"y" * 120)]
    shared = bytes(rng.integers(97, 101, 260, dtype=np.uint8))
    rows += [(k, bytes(rng.integers(97, 101, 60, dtype=np.uint8)) + shared[: 150 + k] + bytes(rng.integers(97, 101, 40, dtype=np.uint8))) for k in range(10, 60)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in suffix.dedup(df, width=200).collect()}
    assert got == covered(rows, 200)


def test_repeats_within_hot_grams(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 4)
    monkeypatch.setattr(suffix, "HOT_TASK", 2)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 40, dtype=np.uint8)) * 4 + bytes(rng.integers(97, 99, 70, dtype=np.uint8)) for _ in range(25)]
    rows = [(k, texts[k % 20] + texts[(k * 7) % 20]) for k in range(40)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["n_removed"] for r in suffix.dedup(df).collect()} == covered(rows, 100)


def test_no_table_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    suffix.dedup(spark.createDataFrame([(1, "a" * 200)], "doc_id long, text string")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
