"""The operators on small fixtures, against brute force, exact round trips and stated rules."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fringeflow.llm import components, embed, media, mixing, packing, pii, simhash, suffix, tokens, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "one", None, None, 3), (4, "one two", "en", "b", 7), (5, "One  TWO\n", "en", "b", 9),
    (6, "word " * 30000, "en", "a", 150000), (7, "word " * 30000, "en", "a", 150000), (None, "no id here at all", "en", "c", 17), (3, "one", None, None, 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, and extra columns with clashing names."""
    return spark.createDataFrame(ODD, DOCS).withColumn("size", F.lit("x")).withColumn("component", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("row", F.lit(3)).withColumn("__score", F.lit(4)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def table(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


# --- components ---


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(top)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 SimHash ---


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@settings(max_examples=60)
@given(st.text(alphabet="aB é\t\n", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == slow_fingerprint(text)


def test_long_fingerprint():
    text = " ".join(str(i * i % 977) for i in range(70000))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == slow_fingerprint(text)


@pytest.mark.parametrize("spread", [6, 18, 64])
def test_index_finds_every_link(spread):
    """One group, dense to sparse: the classes are those of all pairs."""
    rng = np.random.default_rng(spread)
    codes = np.unique(rng.integers(0, 1 << min(spread, 62), 700, dtype=np.uint64))
    a, b = simhash.local_links(np.zeros(len(codes), np.int64), codes, 2)
    at = {int(c): i for i, c in enumerate(codes)}
    got, want = np.arange(len(codes)), np.arange(len(codes))
    simhash.merge_labels(got, np.array([at[int(x)] for x in a], int), np.array([at[int(x)] for x in b], int))
    for i in range(len(codes)):
        j = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 2)
        simhash.merge_labels(want, np.full(len(j), i), j)
    assert np.array_equal(got, want)


def test_gray_ranks_of_neighbours_differ_in_one_bit():
    order = np.argsort(simhash.gray_rank(np.arange(256, dtype=np.uint64)))
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_routes_join_all_near_codes(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = set(base.tolist())
    for c in base.tolist():
        for _ in range(4):
            x = c
            for k in rng.integers(0, 64, 2):
                x ^= 1 << int(k)
            codes.add(x)
    codes = sorted(codes)
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in codes], "fp long")
    got = {r[0] % (1 << 64): r[1] for r in components.connected_components(simhash.link_fingerprints(fps)).collect()}
    arr, want = np.array(codes, np.uint64), np.arange(len(codes))
    for i in range(len(arr)):
        j = np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2)
        simhash.merge_labels(want, np.full(len(j), i), j)
    classes = {}
    for c, w in zip(codes, want.tolist(), strict=True):
        classes.setdefault(w, set()).add(got.get(c, ("alone", c)))
    assert all(len(v) == 1 for v in classes.values()) and len(set.union(*classes.values())) == len(classes)


def test_simhash_odd_rows(odd, none):
    rows = [tuple(r) for r in simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()]
    got = {r[0]: r for r in rows}
    assert len(rows) == len(ODD) and got[1][1] == got[2][1] == "0" * 16 and got[2][2] == 1
    assert got[6][1:] == got[7][1:] and got[7][2] == 6 and got[4][1] == got[5][1] and rows.count(got[3]) == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r[0] for r in kept.select("doc_id").collect()) == Counter([1, 3, 3, 4, 6, None])


# --- 2 embeddings ---


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24))
    near = x[rng.integers(0, 300, 400)] + rng.normal(scale=0.18, size=(400, 24))
    v = np.vstack([x, near, x[:50], x[:20] * 3]).astype(np.float32)
    rows = [(i, [float(a) for a in r], 0) for i, r in enumerate(v)]
    bad = [(900, None, 0), (901, [0.0] * 24, 0), (902, [1.0] * 23 + [None], 0), (903, [float("nan")] + [1.0] * 23, 0), (904, [], 0), (905, [1.0, 1.0], 0), (906, [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: r for r in embed.near_duplicates(df).collect()}
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    links = np.array([got[i]["n_links"] for i in range(len(v))])
    assert links.sum() <= s.sum() and links.sum() >= 0.9 * s.sum() and (links <= s.sum(axis=1)).all()
    label = np.arange(len(v))
    for i in range(len(v)):
        j = np.flatnonzero(s[i])
        simhash.merge_labels(label, np.full(len(j), i), j)
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(v))]) > 0.95
    for i in (900, 901, 902, 903, 904):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[906]["n_links"] == 1 and got[906]["component_id"] == 905 and not got[906]["kept"]
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_count_is_calibrated():
    for n in (8, 24):
        c = embed.least_count(n)
        draws = np.random.default_rng(0).binomial(n, embed.COLLIDES, 20000)
        assert (draws >= c).mean() > embed.RECALL - 0.003 and (draws >= c + 1).mean() < embed.RECALL + 0.003


# --- 3 toxicity ---


def test_toxicity_learns_and_swaps_do_not_matter(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(1500):
        toxic = int(rng.random() < 0.3)
        body = list(rng.choice(words, 12))
        if toxic:
            body[rng.integers(0, 12)] = str(rng.choice(["vile", "scumbag"]))
        if rng.random() < (0.6 if toxic else 0.05):  # the labels lean on one group
            body[rng.integers(0, 12)] = "muslim"
        docs.append((i, " ".join(body), "en", "s", 1))
        labels.append((i, 1, toxic))
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    got = {r["doc_id"]: r for r in toxicity.judge(d, model).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i, r in got.items() if r["held_out"]]
    is_vile = {i: bool(re.search("vile|scumbag", docs[i][1])) for i in held}
    assert np.mean([got[i]["predicted"] == is_vile[i] for i in held]) > 0.97
    free = toxicity.train(d, lab, swap_penalty=0.0)

    def change(m):
        read = toxicity.Reader(m.weights)
        return abs(sum(m.weights[k] for k in read("a muslim family")) - sum(m.weights[k] for k in read("a sikh family")))

    assert change(model) < 0.25 * change(free)


def test_toxicity_odd_rows(spark, odd, none):
    lab = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.judge(odd, toxicity.train(odd, lab)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.train(none, lab.limit(0))
    assert toxicity.judge(none, model).count() == 0
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_swap_changes_terms_only():
    got = toxicity.swapped("A Gay man and a muslim walk")
    assert got and got != "A Gay man and a muslim walk" and got.endswith("walk") and toxicity.swapped("mango and blacksmith") is None


# --- 4 suffix-array dedup ---


def slow_dedup(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = True
            seen.add(w)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def passages(seed):
    rng = np.random.default_rng(seed)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdéf"), rng.integers(2, 8))) for _ in range(n))

    shared = [words(n) for n in (14, 25, 60, 200)]
    rows = []
    for i in range(60):
        t = words(int(rng.integers(0, 40)))
        for _ in range(int(rng.integers(0, 4))):
            s = shared[rng.integers(0, 4)]
            a = int(rng.integers(0, 20))
            t += s[a : len(s) - int(rng.integers(0, 20))] + words(int(rng.integers(0, 9)))
        rows.append((i, t))
    rows += [(100 + k, rows[k][1]) for k in range(0, 60, 7)] + [(200, "ab" * 400), (201, "x" * 700), (202, None), (203, ""), (204, "y" * 99), (205, "y" * 100), (206, "y" * 101), (207, "\0" * 300), (-5, shared[2])]
    return rows


@pytest.mark.parametrize("hot, tile, width", [((1024, 64), 1 << 20, 100), ((6, 2), 1 << 12, 100), ((1024, 64), 1 << 20, 61)])
def test_suffix_dedup(spark, monkeypatch, hot, tile, width):
    monkeypatch.setattr(suffix, "HOT", hot[0])
    monkeypatch.setattr(suffix, "HOT_TASK", hot[1])
    monkeypatch.setattr(suffix, "TILE", tile)
    rows = passages(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert table(suffix.dedup(df, width=width)) == slow_dedup(rows, width)


def test_suffix_odd_rows(odd, none):
    rows = suffix.dedup(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) and got[7]["n_removed"] == got[7]["n_bytes"] == 150000 and got[7]["n_spans"] == 1
    assert got[6]["n_removed"] == 150000 - 5 and got[1]["n_bytes"] == 0 and got[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert suffix.dedup(none).count() == 0
    with pytest.raises(ValueError):
        suffix.dedup(odd, width=10)


@settings(max_examples=40)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12).map(sorted), min_size=1, max_size=6))
def test_loser_tree_merges_and_knows_prefixes(runs):
    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))

    prefixes = [[0, *(shared(a, b) for a, b in zip(r, r[1:], strict=False))] if r else [] for r in runs]
    of, at, lcp = suffix.merge_runs(runs, prefixes)
    got = [runs[a][b] for a, b in zip(of, at, strict=True)]
    assert got == sorted(x for r in runs for x in r) and lcp[1:] == [shared(a, b) for a, b in zip(got, got[1:], strict=False)]


# --- 5 mixing ---


def test_mixing_weights_caps_and_determinism(spark, odd, none):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", f"s{i % 5}" if i % 7 else None, 1) for i in range(600)]
    rows += [(1000 + i, "w " * 500, "en", "s0", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixture(df).collect()
    per = {}
    for r, src in zip(sorted(got, key=lambda r: r["doc_id"]), [x[3] for x in sorted(rows)], strict=True):
        p = per.setdefault(src, [0, r["source_size"], r["target"]])
        p[0] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    total = sum(p[1] for p in per.values())
    assert sum(p[2] for p in per.values()) == pytest.approx(total)
    for taken, size, target in per.values():
        assert target <= 3 * size and abs(taken - target) <= 3 * 500
    assert sorted(map(tuple, mixing.mixture(df.repartition(7)).collect())) == sorted(map(tuple, got))
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() >= 1
    assert len(mixing.mixture(odd).collect()) == len(ODD)
    assert mixing.mixture(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_repeats_rows_as_counted(spark):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 3}", 1) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    size = {r[0]: len(r[1].split()) for r in rows}
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["doc_id"]] += size[r["doc_id"]]
    assert {r["doc_id"]: r["taken"] for r in mixing.mixture(df).collect() if r["taken"]} == {k: v for k, v in taken.items() if v}


# --- 6 URLs ---


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://a.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12#y", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://x.org/", "x.org", "/", "org/", "allow"), ("http://x.org", "x.org", "", None, None), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("ftp://q.com/de/a://b", "q.com", "/de/a://b", "com/de/", "block"), (None, "", "", None, None), ("nothing", "", "", None, None), ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    name, said = urls.rule_for(h, p)
    assert tuple(df.select(h, p, name, said).first()) == (host, path, rule, verdict)


def test_url_mining(spark):
    rows = [(i, f"https://{'free-bets' if i % 3 == 0 else 'news'}{i % 4}.{'x' if i % 2 else 'y'}.net/{i}") for i in range(400)]
    lab = spark.createDataFrame([(u, "block" if "bets" in u else "allow") for _, u in rows[:200]] + [(None, "block"), ("http://z", None)], "url string, label string")
    pages = spark.createDataFrame([*rows, (None, None), (401, ""), (401, "")], "page_id long, url string").withColumn("host", F.lit(0))
    got = urls.judge(pages, labelled=lab).collect()
    assert len(got) == 403 and all(r["verdict"] == ("block" if "bets" in r["host"] else "allow") for r in got)
    assert urls.judge(pages.limit(0)).count() == 0


def test_pruned_rules_and_index_agree_with_brute_force():
    rng = np.random.default_rng(6)
    rules = [(tuple(sorted(set(rng.choice(list("abcdefg"), rng.integers(1, 4))))), str(rng.choice(["allow", "block"])), float(rng.integers(80, 101)) / 100, float(rng.integers(1, 9)) / 100) for _ in range(60)]
    kept = urls.pruned(rules)
    for r in set(rules) - set(kept):
        assert any(set(k[0]) <= set(r[0]) and k[1] == r[1] and k[2] >= r[2] for k in kept)
    index = urls.Index(kept)
    for _ in range(50):
        have = set(rng.choice(list("abcdefg"), 4))
        fits = [(k[2], k[3], len(k[0]), k[1]) for k in kept if set(k[0]) <= have]
        assert index.best(sorted(have)) == (max(fits)[3] if fits else None)


# --- 7 packing ---


@settings(max_examples=40)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-1, 3), st.integers(-1, 3)), max_size=60))
def test_best_fit_is_tightest_compatible(items):
    items = sorted(items, key=lambda x: -x[0])
    bins, starts = packing.best_fit(*map(list, zip(*items, strict=True)), 50) if items else ([], [])
    content, used = {}, {}
    for (size, s, c), b, at in zip(items, bins, starts, strict=True):
        fits = {k: 50 - used[k] for k in used if 50 - used[k] >= size and all((s < 0 or s != x) and (c < 0 or c != y) for x, y in content[k])}
        if fits:
            assert b in fits and fits[b] == min(fits.values()) and at == used[b]
        else:
            assert b not in used and at == 0
        content.setdefault(b, []).append((s, c))
        used[b] = used.get(b, 0) + size


def test_packing_whole(spark, odd, none):
    rows = [(i, " ".join(["w"] * (i * 37 % 900)), "en", f"s{i % 4}", 1) for i in range(300)] + [(7, "w " * 5000, "en", None, 1)] * 3
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), shard_rows=64).collect()
    want = Counter()
    for r in rows:
        want[r[0]] += len(r[1].split())
    have, bins = Counter(), {}
    for r in got:
        have[r["doc_id"]] += r["n_words"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert have == want
    for rs in bins.values():
        rs.sort(key=lambda r: r["bin_start"])
        assert sum(r["n_words"] for r in rs) <= 2048 and len({r["cluster"] for r in rs}) == len(rs)
        assert all(a["bin_start"] + a["n_words"] == b["bin_start"] for a, b in zip(rs, rs[1:], strict=False))
        named = [r["source"] for r in rs if r["source"] is not None]
        assert len(named) == len(set(named))
    assert {r["doc_id"] for r in packing.pack_documents(odd).collect()} == {r[0] for r in ODD}
    assert packing.pack_documents(none).count() == 0


# --- 8 PII ---


def slow_base(text):
    def good(m, low, high):
        return low <= len(re.sub(r"[^0-9]", "", m.group())) <= high

    def luhn(m):
        d = [int(x) for x in re.sub(r"[^0-9]", "", m.group())][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if good(m, 16, 19) and luhn(m)],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if good(m, 8, 15)],
    }


@settings(max_examples=400)
@given(st.text(alphabet="a.@-+ 0159(é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_base(text)


def test_base_spans_in_prose():
    text = "Ü mail a.b+c@x-y.co.uk, 10.0.0.255 or 10.0.0.256; 1.2.3.4.5; 4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (555) 010-9999. a@b@c.de d@e"
    assert pii.base_spans(text) == slow_base(text)
    big = "1" * 200_000 + " " + "a" * 200_000 + "@" + "b" * 1000 + " " + "+1" + "-" * 100_000
    assert not any(pii.base_spans(big).values())


@pytest.mark.parametrize("text, kind, part", [
    ("write to john.doe [at] example [dot] com today", "email", "john.doe [at] example [dot] com"), ("jane(at)mail.example.org!", "email", "jane(at)mail.example.org"),
    ("reach bob at example dot com now", "email", "bob at example dot com"), ("jоhn@example.com", "email", "jоhn@example.com"),
    ("call plus one five five five zero one zero nine nine nine nine please", "phone", "plus one five five five zero one zero nine nine nine nine"),
    ("at one nine two dot one six eight dot zero dot one it listens", "ip", "one nine two dot one six eight dot zero dot one"),
    ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
])
def test_disguises_keep_offsets(text, kind, part):
    base, more = pii.find(text)
    found = [text[s:e] for s, e in base[kind] + more[kind]]
    assert any(part == f or (kind == "email" and f in part) for f in found) and more[kind]


@pytest.mark.parametrize("text", ["we met at noon and at night", "look at this dot matrix", "one two three", "привет мир", "f(x) at g(y)", "a . b . c", "twenty one or two people at five", ""])
def test_clean_texts_have_nothing(text):
    base, more = pii.find(text)
    assert not any(base.values()) and not any(more.values()) and pii.redacted(text) == text


def test_pii_rows(spark, odd, none):
    text = "x a@b.co y +49 (30) 1234567 z 1.2.3.4"
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, "en", "s", None)], DOCS)
    got = table(pii.digests(pii.detect(df)))
    spans = "email:2:8,ip:30:37,phone:11:27"
    assert got[1][:4] == (1, 1, 0, 1) and got[1][4] == hashlib.sha256(spans.encode()).hexdigest() and got[1][5] == spans
    assert got[2][4] == hashlib.sha256(b"").hexdigest() and got[2][5] == ""
    red = table(pii.redact(df).select("doc_id", "text", "n_chars"))
    assert red[1] == ("x <EMAIL> y <PHONE> z <IP>", 26) and red[2] == (None, None)
    assert pii.detect(odd).count() == len(ODD) and pii.redact(odd).columns == odd.columns and pii.detect(none).count() == 0


# --- 9 media ---


def test_interleaved_items_and_payloads(spark):
    html = '<p>One<img src="data:image/png;base64,AAEC" alt="dots">two</p><script>x</script><figure><img src="/a.jpg"><figcaption>A <b>cap</b></figcaption></figure><p>end'
    digest = hashlib.sha256(b"\0\1\2").hexdigest()
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain"), (1, html)], "page_id long, html string").withColumn("items", F.lit(0))
    seq = media.interleave(pages)
    assert seq.count() == 5
    rows = [r for r in media.resolve(seq, spark.createDataFrame([(digest, b"\0\1\2"), (digest, b"\0\1\2"), (None, b"x")], "digest string, media binary")).collect() if r["page_id"] == 1]
    one = sorted({(r["position"], r["kind"], r["text"] or r["src"], r["caption"], None if r["media"] is None else bytes(r["media"])) for r in rows})
    assert len(rows) == 2 * len(one)
    assert [x[:2] for x in one] == [(0, "text"), (1, "img"), (2, "text"), (3, "img"), (4, "text")]
    assert one[1][3:] == ("dots", b"\0\1\2") and one[3][2:] == ("/a.jpg", "A cap", None) and [one[i][2] for i in (0, 2, 4)] == ["One", "two", "end"]


@given(st.binary(max_size=400))
def test_samples_round_trip(data):
    p = media.padded(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p[: len(data)] == data and not any(p[len(data) :]) and media.from_samples(media.to_samples(p)) == p


def test_text_media(odd, none):
    got = media.text_media(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] in (6, 7):
            p = media.padded(("word " * 30000).encode())
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (150000, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            assert r["media_sha256"] == hashlib.sha256(media.to_samples(p)).hexdigest() and r["media_bytes"] == len(media.to_samples(p))
    assert media.text_media(none).count() == 0
    with pytest.raises(ValueError):
        media.from_samples(b"P5\n64 2\n255\n" + bytes(64))


# --- 10 tokens ---


def test_frames_round_trip():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 50257, n).astype(np.uint16) for n in (1, 2, 0, 9000)] + [(rng.zipf(1.3, 6000) % 60000).astype(np.uint16), np.full(5000, 65534, np.uint16), np.tile(np.arange(50, dtype=np.uint16), 200)]
    frame = tokens.write_frame(docs)
    back = tokens.read_frame(frame)
    assert len(back) == len(docs) and all(np.array_equal(a, b) for a, b in zip(docs, back, strict=True))
    assert len(tokens.write_frame(docs[-2:])) < 4000 and tokens.read_frame(tokens.write_frame([])) == []
    broken = bytearray(frame)
    broken[-2000] ^= 4
    with pytest.raises(ValueError):
        tokens.read_frame(bytes(broken))
    with pytest.raises(ValueError):
        tokens.read_frame(b"other" + frame)


def test_tokens_of_texts(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, fast = Tokenizer.from_file(path), tokens.Encoder(path)
    for t in ["a  b \n c", " x", "x ", "\n\n a", "é  \t", "", "a\u2003b c", "don't  stop", "<|endoftext|> a <|endoftext|>", "日本 語 \x1c x", "a\x85 b", "Über-x.\nNeu ×3 a_b 12ab it's", "ǁ ɐ ſt ª²", "x\n"]:
        assert fast(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t
    got = tokens.read(tokens.write(odd.where("doc_id is not null and doc_id <> 3"), path))
    rows = {r["doc_id"]: r for r in got.collect()}
    start = 0
    for i, t in sorted((r[0], r[1]) for r in ODD if r[0] not in (None, 3)):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.read(tokens.write(odd, path)).count() == len(ODD) and tokens.read(tokens.write(none, path)).count() == 0
