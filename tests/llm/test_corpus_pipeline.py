"""The pipeline and the registry of queries, on small tables."""

import re

import corpus_pipeline
from fringeflow.llm import pii, queries, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_against_a_plain_run(spark, tmp_path):
    docs, labels = [], []
    for i in range(240):
        body = " ".join(f"v{(i * 31 + k * 17) % 997}{'abcdefg'[k % 7]}" for k in range(40))
        if i % 8 == 3:
            body = f"vile scumbag {body} vile"
        if i % 10 == 5:
            body = docs[i - 1][1]
        if i % 9 == 1:
            body += f" mail me{i}@example.com"
        docs.append((i, body, "en", f"s{i % 3}", len(body)))
        labels.append((i, 1, int("vile" in body)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s0", 0)]
    d = str(tmp_path / "t")
    write(spark, d, docs, labels)
    frames, at = [], spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, d)
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(at)
        assert k == len(corpus_pipeline.STAGES) - 1 or at.columns == COLUMNS, name
    text = {r[0]: r[1] for r in docs}
    kept = {r[0] for r in frames[0].collect()}
    assert {i for i in text if "vile" in (text[i] or "")} == set(text) - kept
    sets = {i: simhash.shingles((text[i] or "").encode()) for i in kept}
    near = lambda a, b: (not a and not b) or bool(a & b) and len(a & b) >= 0.8 * len(a | b)
    alone = {i for i in kept if not any(j < i and near(sets[i], sets[j]) for j in kept)}  # no chains among these texts
    assert {r[0] for r in frames[1].collect()} == alone
    for r in frames[2].collect():
        want = re.sub(r"me\d+@example\.com", "<EMAIL>", text[r["doc_id"]]) if text[r["doc_id"]] else text[r["doc_id"]]
        assert r["text"] == want == pii.redacted(text[r["doc_id"]]) and (r["text"] is None or r["n_chars"] == len(want))
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in frames[2].collect()}
    packed = frames[4].collect()
    mixed = [r["doc_id"] for r in frames[3].collect()]
    assert sorted(r["doc_id"] for r in packed) == sorted(mixed) and all(r["n_words"] == words[r["doc_id"]] for r in packed)
    assert corpus_pipeline.run(spark, d).count() == len(packed)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path / "t")
    write(spark, d, [], [])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_each_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES) and toxicity.THRESHOLD == 0.7


def test_mixing_matches_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES["op5_mixing"](spark, sf)
    want = db.sql(queries.ORACLES["op5_mixing"])
    assert got.columns == list(want.columns) and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
