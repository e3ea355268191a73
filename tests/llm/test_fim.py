"""Fill-in-middle against plain Python, exact restoring, and each unit grammar."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fringeflow.llm import fim


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["", None, "x", "ab", "a😀b😀é é", "<P>", "a <S> b", "a<M", "M><", "<<P", "S>x<", " \n\n ", "line\r\nline\rline\n", "one. two! three? 四。五", "\x00\x01", "word " * 3000, "😀" * 5000]


def test_against_plain_python(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(400)] + [(700, "twice", "x"), (700, "twice", "y"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").withColumn("units", F.lit(1)).withColumn("form", F.lit("z"))
    got = fim.transform(docs)
    told = {}
    for r in fim.digests(got).collect():
        told.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        n, form, a, m, out = plain(i, text)
        for r in told[i]:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, m)
            assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
            assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert sum(map(len, told.values())) == len(rows)
    assert {r.form for v in told.values() for r in v} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", list(fim.GRAMMARS))
def test_units_lose_nothing_and_restore(spark, unit):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 8)], "doc_id long, text string")
    got = fim.transform(docs, unit=unit).select("*", fim.units(F.col("text"), unit).alias("u"), fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(TEXTS) * 8
    for r in got:
        assert "".join(r.u) == r.text == r.back and r.n == len(r.u) and all(r.u)
        assert r.form == "plain" or r.prefix + r.middle + r.suffix == r.text


def test_where_units_end(spark):
    text = "Hi, you 12. So\n\nit 四。五 éx"
    expected = {
        "word": re.findall(r"\S+\s*", text), "line": ["Hi, you 12. So\n", "\n", "it 四。五 éx"], "sentence": ["Hi, you 12. ", "So\n\nit 四。", "五 éx"],
        "paragraph": ["Hi, you 12. So\n\n", "it 四。五 éx"], "run": re.findall(r"[a-zA-Z四五́]+|[0-9]+|\s+|.", text), "character": list(text),
    }
    row = spark.createDataFrame([(text,)], "t string").select(*[fim.units(F.col("t"), u).alias(u) for u in expected]).first()
    for unit, pieces in expected.items():
        assert row[unit] == pieces, unit


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(fim.transform(docs)).count() == 0
