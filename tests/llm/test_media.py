"""Every row of documents against a plain run, and references by digest in pages."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from fringeflow.llm import media, queries

SF = "/root/testdata/sf0.001"


def plain(text):
    raw = (text or "").encode()
    p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
    x = np.frombuffer(p, np.uint8).astype(float)
    stored = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
    quarters = "/".join(str(int(((x >= q) & (x < q + 64)).sum()) * 1000 // len(x)) for q in (0, 64, 128, 192))
    total, squares = int(x.sum()), int((x * x).sum())
    feature = f"64x{len(p) // 64};mean={total * 1000 // len(x)};var={(squares * len(x) - total * total) // len(x) ** 2};quarters={quarters}"
    return (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, f"{len(raw)} bytes")


def test_all_documents_against_a_plain_run(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op9_media"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:9] == plain(texts[r["doc_id"]]) and r["n_items"] >= 1


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "é" * 40), (4, "a" * 64), (5, "a" * 65), (6, "\0"), (7, "x <img src='b.png' alt='B'> <p>y</p> <script>z</script>"), (8, "<figure><figcaption>c"), (8, "<figure><figcaption>c"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("digest", F.lit("d"))
    got = sorted((tuple(r) for r in media.text_media(df).collect()), key=str)
    items = {1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 4, 8: 2, None: 2}
    assert got == sorted(((i, *plain(t), items[i]) for i, t in rows), key=str)


def test_pages_refer_to_stored_texts(spark):
    """Pages that show documents by digest get their payloads, in order, with their captions."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    _, payloads = media.store_texts(docs)
    name = {i: hashlib.sha256(media.padded(f"text {i}".encode())).hexdigest() for i in range(5)}
    html = "".join(f"<p>p{i}</p><figure><img src='digest:{name[i]}'><figcaption>c{i}</figcaption></figure>" for i in (3, 1, 3)) + "<img src='digest:none' alt='gone'>"
    got = media.resolve(media.interleave(spark.createDataFrame([(1, html)], "page_id long, html string")), payloads).orderBy("position").collect()
    assert [(r["kind"], r["text"] or r["caption"]) for r in got] == [("text", "p3"), ("img", "c3"), ("text", "p1"), ("img", "c1"), ("text", "p3"), ("img", "c3"), ("img", "gone")]
    assert [r["media"] and media.from_samples(bytes(r["media"])).rstrip(b"\0") for r in got] == [None, b"text 3", None, b"text 1", None, b"text 3", None]


def test_all_items_of_a_text_with_their_payloads(spark):
    """References by digest resolve to other documents, inline ones to what they hold, others to nothing; order, captions and repeats stay."""
    name = hashlib.sha256(media.padded(b"shared")).hexdigest()
    html = f"<p>one</p><figure><img src='digest:{name}'><figcaption>cap</figcaption></figure>two<img src='data:text/plain;base64,aGVsbG8=' alt='hi'><img src='x.png'><img src='data:,'>"
    rows = [(1, html), (1, html), (2, "shared"), (3, None), (4, "plain text only")]
    got = media.text_media(spark.createDataFrame(rows, "doc_id long, text string"), with_items=True).collect()
    assert len(got) == len(rows)
    for r in got:
        items = [(x["position"], x["kind"], x["chars"], x["caption"], x["payload_bytes"]) for x in r["items"]]
        assert [x[0] for x in items] == list(range(r["n_items"])) and items[0] == (0, "img", None, f"{r['n_bytes']} bytes", r["payload_bytes"])
        if r["doc_id"] == 1:
            assert items[1:] == [(1, "text", 3, None, None), (2, "img", None, "cap", 64), (3, "text", 3, None, None), (4, "img", None, "hi", 5), (5, "img", None, None, None), (6, "img", None, None, 0)]
        elif r["doc_id"] == 4:
            assert items[1:] == [(1, "text", 15, None, None)]
