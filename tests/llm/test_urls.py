"""Mining against brute force, the least number of rows behind a rule, and labels that are not the stated rules restated."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from fringeflow.llm import urls


def brute(rows, least, min_confidence):
    """All rules (tokens, label): (confidence, support) of the labelled token sets, by looking at every subset."""
    whole, by_label = Counter(), Counter()
    for toks, label in rows:
        for k in range(1, len(toks) + 1):
            for sub in combinations(sorted(toks), k):
                whole[sub] += 1
                by_label[sub, label] += 1
    return {(s, y): (n / whole[s], n / len(rows)) for (s, y), n in by_label.items() if n >= least and n / whole[s] >= min_confidence}


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_decide_as_all_rules_do(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(150):
        toks = {f"a={rng.integers(3)}", f"b={rng.integers(4)}", "c=all", *(f"d={k}" for k in range(3) if rng.random() < 0.4)}
        if "a=1" in toks:
            toks.add("twin=1")
        bad = ("a=1" in toks and "d=0" in toks) or "b=3" in toks
        rows.append((sorted(toks), "block" if bad != (rng.random() < 0.05) else "allow"))
    df = spark.createDataFrame(rows, "__tokens array<string>, label string")
    mined, same = urls.mine(df, min_support=0.02, min_confidence=0.8, least_rows=5)
    want = brute([(tuple(t), y) for t, y in rows], 5, 0.8)
    for toks, label, confidence, support in mined:
        assert want[toks, label] == pytest.approx((confidence, support))
    for toks, _ in rows:
        have = {same[t] for t in toks if t in same}
        best = max((c, y) for (s, y), (c, _) in want.items() if set(s) <= set(toks)) if any(set(s) <= set(toks) for s, _ in want) else None
        got = [(c, y) for s, y, c, _ in mined if set(s) <= have]
        assert (max(got)[0] if got else None) == (best and pytest.approx(best[0]))


def test_no_rule_from_a_few_rows(spark):
    rows = [(["x=1"], "block")] * 4 + [(["x=2"], "block")] * 5 + [(["x=3"], "allow")] * 30
    mined, _ = urls.mine(spark.createDataFrame(rows, "__tokens array<string>, label string"), min_support=0.0001)
    assert {(s, y) for s, y, _, _ in mined} == {(("x=2",), "block"), (("x=3",), "allow")}
    assert urls.mine(spark.createDataFrame(rows[:4], "__tokens array<string>, label string")) == ([], {})


def test_stated_rules_are_not_mined_again(spark):
    assert urls.told_by("example.org/en/1") == (frozenset({"host0=org", "host1=example", "path0=en"}), "path1=")
    assert urls.told_by("com/de/") == (frozenset({"host0=com", "path0=de"}), "") and urls.told_by("org/") == (frozenset({"host0=org"}), "")
    rows = [(i, f"http://w{i % 7}.com/{'de' if i % 2 else 'fr'}/{'spam' if i % 2 else 'news'}/{i}") for i in range(60)]
    rows += [(100, "http://w.net/de/x"), (101, "http://w.net/other/spam/x"), (102, "http://w.net/de/news/1")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("com/de/", "block") and got[2] == ("com/fr/", "allow")
    # what went with the verdicts is learned, the rules' own tokens are not
    assert got[100] == (None, "allow") and got[101] == (None, "block") and got[102] == (None, "allow")


def test_masking_does_not_turn_a_stated_rule_round(spark):
    """`de` goes with block on .com; a few .org pages under /de/ are allowed, which must not teach that `de` is allowed."""
    rows = [(i, f"http://w{i}.com/de/{i}") for i in range(40)] + [(100 + i, f"http://v{i}.org/de/{i}") for i in range(30)] + [(200 + i, f"http://u{i}.com/fr/{i}") for i in range(60)]
    rows += [(1000, "http://x.net/de/1"), (1001, "http://x.net/fr/1")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000]["mined"] is None or "path0=de" not in got[1000]["mined"]
    assert not any(r["mined"] and ("path0=" in r["mined"] or "host0=" in r["mined"]) for r in got.values())


def test_mined_rules_decide_planted_pages(spark):
    """Shops under a session name are blocked, wikis allowed; pages that no stated rule decides follow, and say by which tokens."""
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, f"http://{'shop' if bad else 'wiki'}{i % 9}.com/{'de' if bad else 'fr'}/{'buy' if bad else 'page'}/{i}{'?session=' + str(i) if bad else ''}"))
    rows += [(1000 + i, f"http://s{i}.net/x/buy/{i}?session={i}") for i in range(20)] + [(2000 + i, f"http://s{i}.net/x/page/{i}") for i in range(20)] + [(3000 + i, f"http://s{i}.net/other{i}") for i in range(20)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[1000 + i]["verdict"] == "block" and got[1000 + i]["mined"] for i in range(20))
    assert all(got[2000 + i]["verdict"] == "allow" for i in range(20))
    assert all(got[3000 + i]["verdict"] == urls.DEFAULT and got[3000 + i]["mined"] is None for i in range(20))
    assert all(got[i]["mined"] is None and got[i]["rule"] for i in range(300))


def test_chi_squared():
    assert urls.chi_squared(5, 5, 9, 39) == pytest.approx(39 * (5 * 30) ** 2 / (5 * 34 * 9 * 30))
    assert urls.chi_squared(5, 5, 5, 5) == 0
