"""Toxicity: a logistic regression over words and word beginnings, trained with counterfactual pairs.

Each labelled text is also read with an identity term swapped for another of its language; a text that has
none gets one inserted first, under the same label. The training penalises any change of the log-odds under the
swap, and under the insertion, so that a neutral mention of a group moves no score. Features are counted over a bounded, hash-chosen
sample of the labelled rows; the best are kept, and the terms' own; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fringeflow.llm.store import materialize

#: Labelled rows that are learned from, about; buckets that features are hashed to; buckets that are kept.
MAX_LABELLED, BUCKETS, MAX_FEATURES = 30_000, 1 << 20, 4096
#: A feature is kept if so many texts have it and it stands so many standard deviations from no effect.
LEAST_TEXTS, LEAST_Z = 3, 5.0
THRESHOLD = 0.7
#: Words that a task remembers.
_REMEMBERED = 250_000

# Terms that name groups, by language; a term is swapped for another of its language and number.
IDENTITY_TERMS = {
    "en": (
        "african", "american", "asian", "atheist", "bisexual", "black", "blind", "buddhist", "canadian", "catholic", "chinese",
        "christian", "deaf", "disabled", "elderly", "european", "female", "gay", "hindu", "hispanic", "immigrant", "indian",
        "japanese", "jewish", "latino", "lesbian", "male", "mexican", "muslim", "old", "queer", "refugee", "sikh", "straight",
        "trans", "transgender", "white", "woman", "man", "young",
    ),
    "es": (
        "africano", "americano", "asiático", "ateo", "blanco", "budista", "católico", "ciego", "chino", "cristiano", "discapacitado",
        "europeo", "gitano", "indio", "inmigrante", "japonés", "joven", "judío", "lesbiana", "mexicano", "mujer", "hombre", "musulmán",
        "negro", "refugiado", "sordo", "transexual", "anciano",
    ),
    "fr": (
        "africain", "américain", "arabe", "asiatique", "athée", "aveugle", "blanc", "bouddhiste", "catholique", "chinois", "chrétien",
        "européen", "femme", "handicapé", "homme", "immigré", "indien", "japonais", "jeune", "juif", "lesbienne", "mexicain", "musulman",
        "noir", "réfugié", "sourd", "transgenre", "vieux",
    ),
    "de": (
        "afrikaner", "amerikaner", "araber", "asiate", "atheist", "behinderter", "blinder", "buddhist", "chinese", "christ", "einwanderer",
        "europäer", "flüchtling", "frau", "mann", "inder", "japaner", "jude", "katholik", "lesbe", "mexikaner", "muslim", "schwarzer",
        "schwuler", "türke", "weißer",
    ),
}
# Plurals that no rule of _plural gives.
_PLURALS = {"woman": "women", "man": "men", "joven": "jóvenes", "frau": "frauen", "mann": "männer", "christ": "christen", "katholik": "katholiken"}


def _plural(term: str, language: str) -> str:
    if term in _PLURALS:
        return _PLURALS[term]
    last = term[-1]
    if language == "de":
        return term if term.endswith("er") else term + ("n" if last == "e" else "en" if term.endswith("ist") else "e")
    if language == "es" and term.endswith(("és", "án")):
        return term[:-2] + {"é": "es", "á": "an"}[term[-2]] + "es"
    if language == "es" and last not in "aeiou":
        return term + "es"
    return term if last in "sx" else term + "s"


#: The terms that each stands beside: its language's, of its number.
_BESIDE: dict[str, tuple[str, ...]] = {}
for _language, _terms in IDENTITY_TERMS.items():
    for _group in (_terms, tuple(_plural(t, _language) for t in _terms)):
        for _term in _group:
            _BESIDE.setdefault(_term, _group)

_WORD = re.compile(r"\w+")


@dataclass
class Model:
    bias: float
    weights: dict[int, float]  # by bucket


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _of_word(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    marks = [f"={word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) > n)]
    return [xxhash.xxh32_intdigest(m) % BUCKETS for m in marks]


def _other(term: str, shift: int) -> str:
    beside = _BESIDE[term]
    return beside[(beside.index(term) + 1 + shift % (len(beside) - 1)) % len(beside)]


def swapped(text: str) -> str | None:
    """text with each identity term replaced by another, always the same one; None if it has none."""
    if _BESIDE.keys().isdisjoint(_WORD.findall(text.lower())):
        return None
    shift = xxhash.xxh32_intdigest(text)
    return _WORD.sub(lambda m: _other(x, shift) if (x := m.group().lower()) in _BESIDE else m.group(), text)


def counterfactual(words: set[str], seed: int) -> tuple[set[str], set[str], set[str]]:
    """Of a text's words: what is inserted, what the swap then takes away, and what it puts there instead.

    A text without an identity term gets one (of any language) inserted first; one that has terms keeps them.
    """
    have, put = words & _BESIDE.keys(), set()
    if not have:
        have = put = {_ALL_TERMS[seed % len(_ALL_TERMS)]}
    new = {_other(t, seed // len(_ALL_TERMS)) for t in have}
    return put, have - new, new - have - words


_ALL_TERMS = sorted(_BESIDE)


class Reader:
    """Buckets (of those wanted) that a text has; remembers words, in bounded memory."""

    def __init__(self, wanted: dict | None = None):
        self.wanted, self.known = wanted, {}

    def __call__(self, text: str | None) -> set[int]:
        return self.of(set(_WORD.findall(text.lower())) if text else set())

    def of(self, words: set[str]) -> set[int]:
        found: set[int] = set()
        known = self.known
        for w in words:
            got = known.get(w)
            if got is None:
                got = tuple(b for b in _of_word(w) if self.wanted is None or b in self.wanted)
                if len(known) >= _REMEMBERED:
                    known.clear()
                known[w] = got
            if got:
                found.update(got)
        return found


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    share = min(1.0, max_labelled / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return materialize(texts.join(F.broadcast(known), "doc_id").select("y", "text"), "labelled")  # about max_labelled rows of two numbers


def _counts(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, texts): how many toxic texts, and how many at all, have the bucket; summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, n, pos = Reader(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.fromiter(read(t), np.int64)
                n[at] += 1
                if y:
                    pos[at] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pos[at]), pa.array(n[at])], ["bucket", "toxic", "texts"])

    return sample.mapInArrow(count, "bucket long, toxic long, texts long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))


def _rows(sample: DataFrame, buckets: list[int]) -> DataFrame:
    """For each text its y, places in `buckets` that it has (x), those that the inserted term adds, and what a swap then takes and puts."""
    place = {b: i for i, b in enumerate(buckets)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(place)

        def at(found: set[int]) -> list[int]:
            return sorted(place[k] for k in found)

        for b in batches:
            cols = [[] for _ in range(4)]
            for t in b.column(1).to_pylist():
                words = set(_WORD.findall(t.lower())) if t else set()
                put, gone, new = counterfactual(words, xxhash.xxh32_intdigest(t or ""))
                x, told, other = reader.of(words), reader.of(words | put), reader.of((words | put) - gone | new)
                for c, found in zip(cols, (x, told - x, told - other, other - told), strict=True):
                    c.append(at(found))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c in cols)], ["y", "x", "put", "gone", "new"])

    return sample.mapInArrow(read, "y int, x array<int>, put array<int>, gone array<int>, new array<int>")


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), size), np.concatenate([np.array(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])


def fit(y: np.ndarray, x: list, put: list, gone: list, new: list, n: int, swap_penalty: float = 1.0, ridge: float = 1e-5, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of n features: mean log-loss of the texts and of the same with a term inserted + ridge * |w|^2 + swap_penalty * (mean (log-odds change under a swap)^2 + the same under the insertion)."""
    row, col = _flat(x)
    (rp, cp), (rg, cg), (rn, cn) = map(_flat, (put, gone, new))
    size = max(1, len(y))
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], len(y))
        told = z + np.bincount(rp, w[cp], len(y))
        e, more = (((1 / (1 + np.exp(-np.clip(s, -40, 40)))) - y) / (2 * size) for s in (z, told))
        g = np.bincount(col, (e + more)[row], n) + np.bincount(cp, more[rp], n) + 2 * ridge * w
        d = (np.bincount(rg, w[cg], len(y)) - np.bincount(rn, w[cn], len(y))) * (2 * swap_penalty / size)
        g += np.bincount(cg, d[rg], n) - np.bincount(cn, d[rn], n)
        d = np.bincount(rp, w[cp], len(y)) * (2 * swap_penalty / size)
        g += np.bincount(cp, d[rp], n)
        g = np.append(g, (e + more).sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return float(b), w


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, swap_penalty: float = 1.0) -> Model:
    """Learn from at most about max_labelled labelled rows that are not held out.

    Features are the MAX_FEATURES words and beginnings that tell the classes apart best, among those LEAST_TEXTS
    texts have and that stand LEAST_Z deviations from no effect, and all of the identity terms'. Without rows of
    both classes no feature is kept and every score is the (clipped) share of toxic rows.
    """
    sample = _sample(docs, labels, max_labelled)
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = min(max(toxic / total if total else 0.0, 1e-3), 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    if not 0 < toxic < total:
        return Model(prior, {})
    p, q = F.col("toxic") / toxic, (F.col("texts") - F.col("toxic")) / (total - toxic)
    mean = F.col("texts") / total
    z = F.abs(p - q) / F.sqrt(mean * (1 - mean) * (1 / toxic + 1 / (total - toxic)) + 1e-12)
    best = _counts(sample).where(F.col("texts") >= LEAST_TEXTS).select("bucket", z.alias("z")).where(F.col("z") >= LEAST_Z)
    buckets = [r[0] for r in best.orderBy(F.col("z").desc(), "bucket").limit(MAX_FEATURES).collect()]
    buckets += sorted({b for t in _ALL_TERMS for b in _of_word(t)} - set(buckets))
    rows = _rows(sample, buckets).toArrow()  # bounded: max_labelled rows of at most as many places as there are features
    bias, w = fit(rows["y"].to_numpy().astype(float), *(rows[c].to_pylist() for c in ("x", "put", "gone", "new")), len(buckets), swap_penalty)
    return Model(bias, {b: float(x) for b, x in zip(buckets, w, strict=True)})


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "__score") -> DataFrame:
    """docs with one more column (named unlike any of its own): each whole text's score, 0 to 1; null and empty texts have no features."""
    place = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, weight, bias = Reader(model.weights), model.weights, model.bias
        for b in batches:
            z = np.array([bias + sum(weight[k] for k in sorted(read(t))) for t in b.column(place).cast(pa.string()).to_pylist()], float)
            yield b.append_column(score_col, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))))

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; predicted is 1 from THRESHOLD on."""
    out = with_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below THRESHOLD, with the columns they had."""
    score = "__score"
    while score in docs.columns:
        score += "_"
    return with_score(docs, model, score_col=score).where(F.col(score) < THRESHOLD).drop(score)
