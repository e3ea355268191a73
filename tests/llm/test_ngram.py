"""The language model against one in plain Python, its probabilities' sums, and the odd cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fringeflow.llm import ngram

END = "</s>"


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.words = Counter(w for t in texts for w in cut(t))
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            s = ["<s>"] * (order - 1) + cut(t)
            for i in range(order - 1, len(s)):
                grams[order][tuple(s[i - order + 1 : i + 1])] += 1
        for n in range(order - 1, 0, -1):
            grams[n] = Counter(g[1:] for g in grams[n + 1])
        self.grams = grams
        self.off = [None] + [ngram.discounts(np.array([sum(c == k for c in grams[n].values()) for k in range(1, 5)])) for n in range(1, order + 1)]
        self.after = [defaultdict(list) for _ in range(order + 1)]
        for n in range(1, order + 1):
            for g, c in grams[n].items():
                self.after[n][g[:-1]].append(c)

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(self.words) + 1)
        lower, counts = self.p(gram[1:]), self.after[n].get(gram[:-1])
        if not counts:
            return lower
        d = (0.0, *self.off[n])
        c = self.grams[n].get(gram, 0)
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in counts) * lower) / sum(counts)

    def score(self, text):
        s = ["<s>"] * (self.order - 1) + cut(text)
        return sum(math.log10(self.p(tuple(s[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(s)))

    def base(self, text):
        n, v = sum(self.words.values()), len(self.words)
        return sum(math.log10((self.words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in cut(text))


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    vocab = ["the", "The", "é", "a", "straße", "ÉA", "b-c"] + [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 20, 60])
        out.append(rng.choice([" ", "\n", " \t "]).join(vocab[min(int(rng.expovariate(0.12)), len(vocab) - 1)] for _ in range(k)) + rng.choice(["", " "]))
    return out + [None, "", "  ", out[5], out[5], "x" * 300 + " " + "X" * 300, "new words here"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_plain_python(spark, order, monkeypatch):
    monkeypatch.setattr(ngram, "HOT", 64)  # the frequent contexts are salted
    monkeypatch.setattr(ngram, "BUFFER", 200)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(3)
    learnt = [t for i, t in enumerate(texts) if i % 4]
    model = ngram.train(docs.where("doc_id % 4 > 0"), order=order, part_bytes=700)
    assert model.parts > 3 and len(model.hot) > 2
    plain = Plain(learnt, order)
    assert (model.tokens, model.distinct) == (sum(plain.words.values()), len(plain.words))
    rows = ngram.score(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(cut(t)), sum(w in plain.words for w in cut(t)), model.tokens)
        assert r.base_score == pytest.approx(plain.base(t), rel=1e-9)
        assert r.score == pytest.approx(plain.score(t), rel=1e-9), t
        assert r.perplexity == pytest.approx(10 ** (-plain.score(t) / len(cut(t))), rel=1e-6)


def test_probabilities_of_all_words_sum_to_one(spark):
    texts = corpus(40)
    model = ngram.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    words = sorted({w for t in texts for w in cut(t)} - {END}) + ["unseen"]
    for context in ("the", "w3 w4", "nowhere", ""):
        last = spark.createDataFrame([(f"{context} {w}",) for w in words], "text string").withColumn("doc_id", F.lit(1))
        h, doc, real = ngram._tokens(pa.array([r.text for r in last.collect()]), 2)
        ids = np.where(real, model.words(h)[0], np.uint32(0))
        p = 10 ** model.probabilities(ids, real)
        n = len(context.split()) + 2
        total = p.reshape(len(words), n)[:, n - 2].sum()
        own = pa.array([context])
        h, _, real = ngram._tokens(own, 2)
        ids = np.where(real, model.words(h)[0], np.uint32(0))
        total += 10 ** model.probabilities(ids, real)[-1]
        assert total == pytest.approx(1, rel=1e-9), context


def test_query_holds_out_a_fifth(spark):
    texts = corpus(60)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en"), (None, "the a", None)], "doc_id long, text string, lang string")
    rows = ngram.score_all(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    plain = Plain([t for i, t in [*enumerate(texts), (3, texts[3]), (None, "the a")] if not held(i)], ngram.ORDER)
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = "the a" if r.doc_id is None else texts[r.doc_id]
        assert r.held_out == held(r.doc_id) and r.score == pytest.approx(plain.score(t), rel=1e-9)


def test_empty_table_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = ngram.train(none)
    assert ngram.score(none, model).count() == 0
    r = ngram.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    one = ngram.train(spark.createDataFrame([(None,)], "text string"))
    r = ngram.score(spark.createDataFrame([(1, None)], "doc_id long, text string"), one).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (1, 1, 1) and r.score < 0


def test_words_in_small_pieces(monkeypatch):
    monkeypatch.setattr(ngram, "TILE", 16)
    texts = ["Ab  cd", "", "x" * 40 + " y", "z" * 40, " ", "tail é", "ab CD\x0bEF\x1cgh"] * 3
    h, doc = ngram.words(*ngram._texts(pa.array([None, *texts]).slice(1)))
    assert doc.tolist() == [i for i, t in enumerate(texts) for _ in cut(t)[:-1]]
    of = {}
    for k, w in zip(h.tolist(), [w for t in texts for w in cut(t)[:-1]], strict=True):
        assert of.setdefault(w, k) == k
    assert len(set(of.values())) == len(of)


def test_a_shard_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(0)
    for n in (0, 1, 31, 5000):
        h = rng.integers(1 << 64, size=n, dtype=np.uint64)
        tuples = rng.integers(5, size=(n, 5), dtype=np.uint64)
        s = ngram._shard(h, tuples)
        at = ngram._find(s, h)
        assert (at >= 0).all() and (s["tuples"][s["code"][at]] == tuples).all()
        assert (ngram._find(s, rng.integers(1 << 64, size=1000, dtype=np.uint64)) == -1).all()
