"""The counterfactual part: it acts on the given labels, and false positives on neutral mentions fall in each language."""

import numpy as np
import pytest

from fringeflow.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_penalty_acts_on_the_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity._sample(docs, labels, toxicity.MAX_LABELLED)
    terms = sorted({b for t in toxicity._BESIDE for b in toxicity._of_word(t)})
    rows = toxicity._rows(sample, terms).collect()
    assert rows and all(r["gone"] and r["new"] for r in rows)  # every text has its counterfactual
    with_it, without = (toxicity.train(docs, labels, swap_penalty=p) for p in (1.0, 0.0))
    apart = [abs(with_it.weights[b]) for b in terms], [abs(without.weights[b]) for b in terms]
    assert sum(apart[0]) < 0.5 * sum(apart[1]) and sum(apart[1]) > 0


@pytest.mark.parametrize("language, group", [("en", "muslims"), ("es", "gitano"), ("fr", "juifs"), ("de", "türken")])
def test_fewer_false_positives_on_neutral_mentions(spark, language, group):
    rng = np.random.default_rng(len(group))
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(1200):
        toxic = int(rng.random() < 0.4)
        body = list(rng.choice(words, 10))
        if toxic and rng.random() < 0.5:  # half of the toxic texts say nothing worse than the group's name
            body.append("vile")
        if rng.random() < (0.9 if toxic else 0.02):
            body.append(group)
        docs.append((i, " ".join(body)))
        labels.append((i, toxic))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, " ".join([*rng.choice(words, 10), group])) for i in range(200)], "doc_id long, text string")
    share = {}
    for penalty in (1.0, 0.0):
        got = toxicity.judge(neutral, toxicity.train(d, lab, swap_penalty=penalty)).collect()
        share[penalty] = np.mean([r["predicted"] for r in got])
    assert share[0.0] > 0.5 and share[1.0] < 0.2 * share[0.0]


def test_swaps_keep_language_and_number():
    assert all(len(set(g)) == len(g) for g in toxicity._BESIDE.values())
    for text in ("two women and a man", "los judíos y una mujer", "les juifs et un homme", "die Frauen und der Mann"):
        got = toxicity.swapped(text)
        old, new = text.lower().split(), got.split()
        changed = [(a, b) for a, b in zip(old, new, strict=True) if a != b.lower()]
        assert len(changed) == 2 and all(b in toxicity._BESIDE[a] for a, b in changed)
    put, gone, new = toxicity.counterfactual({"plain", "words"}, 12345)
    assert put == gone and len(put) == 1 and len(new) == 1 and put != new
