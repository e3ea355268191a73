"""The pipeline's near-dedup against all pairs' Jaccard similarity, on planted edits and copies."""

import random

import numpy as np
import pytest

import corpus_pipeline
from fringeflow.llm import simhash


def planted():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(300)]
        texts.append(base)
        one, part, tenth, spread = list(base), list(base), list(base), list(base)
        one[150] = word()
        part[100:115] = [word() for _ in range(15)]
        tenth[200:230] = [word() for _ in range(30)]
        for k in rng.sample(range(300), 15):
            spread[k] = word()
        texts += [one, part, tenth, spread, list(base)]
    chain = [word() for _ in range(300)]
    for k in range(40):  # many near copies of a text, each next one further from the first
        chain = list(chain)
        chain[k * 7] = word()
        texts.append(chain)
    return [" ".join(t) for t in texts] + ["short text", "short text", "short words", "", None]


def test_near_dedup_keeps_what_all_pairs_keep(spark):
    texts = planted()
    sets = [simhash.shingles((t or "").encode()) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a & b and len(a & b) / len(a | b) >= 0.8):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    # no false link, and candidates may miss one pair in fifty at the edge of the similarity
    assert want <= got and len(got - want) <= len(want) // 50
    assert all(i not in got for i in range(1, 360, 6)) and all(i not in got for i in range(5, 360, 6))
    assert not set(range(361, 400)) & got


def test_copies_and_changed_words_of_other_queries_stay_as_they_were(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v w")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def near_group(n, rng):
    """Texts of 150 words, each with words of one text changed in two or three places: hardly two differ alike, most pairs are at 0.7 to 0.8."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for k in rng.sample(range(150), rng.choice((2, 3, 5, 6))):
            words[k] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_pairs_of_a_group_grow_as_its_size(spark, monkeypatch):
    """Also where most of its candidates are less similar than asked for; what is joined is what all pairs join."""
    rows, keep = {}, simhash.materialize

    def counted(df, name):
        out = keep(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    listed = []
    for n in (150, 600):
        texts, rows = near_group(n, random.Random(n)), {}
        got = dict(map(tuple, simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
        sets, want = [simhash.shingles(t.encode()) for t in texts], np.arange(n)
        linked = np.array([(i, j) for j in range(n) for i in range(j) if simhash.similarity(sets[i], sets[j]) >= 0.8])
        simhash.merge_labels(want, *linked.T)
        assert sum(got[i] != want[i] for i in range(n)) <= n // 50
        listed.append(sum(rows["pairs"]))
        assert listed[-1] < 8 * n  # of n * n / 2
    assert listed[1] < 6 * listed[0]


@pytest.mark.parametrize("words", [40, 150, 600, 3000])
def test_sketches_rule_few_similar_pairs_out_and_most_others(words):
    rng, ruled = random.Random(words), {}
    for least in (0.8, 0.68):
        a = []
        for _ in range(300):
            shared = -int(-words * 2 * least // (1 + least))
            common = [f"w{rng.randrange(10**9)}" for _ in range(shared)]
            a.append([simhash.sketched(" ".join(common + [f"v{rng.randrange(10**9)}" for _ in range(words - shared)]).encode(), 1)[2] for _ in range(2)])
        x, y = (np.frombuffer(b"".join(p[k] for p in a), np.uint8).reshape(300, -1) for k in (0, 1))
        ruled[least] = 1 - simhash.may_be_similar(x, y, 0.8).mean()
    assert ruled[0.8] <= 0.02 and ruled[0.68] >= (0.6 if words < 100 else 0.9), ruled
