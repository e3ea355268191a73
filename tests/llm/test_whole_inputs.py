"""Parts of texts, URLs and pages that earlier forms did not look at."""

import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from fringeflow.llm import media, pii, urls

SF = "/root/testdata/sf0.001"


class Always:
    def search(self, text):
        return True


@pytest.mark.parametrize("text, kind", [("call +1 555 seven 34 5678", "phone"), ("call +1 555 seven seven 34 5678", "phone"), ("bob\nat\nexample.com", "email"), ("bob\tat\texample\tdot\tcom", "email"), ("bob at example.com", "email"), ("bob AT example.com", "email")])
def test_gates_are_necessary_conditions(monkeypatch, text, kind):
    got = pii.find(text)
    assert got[1][kind] and f"<{kind.upper()}>" in pii.redacted(text)
    monkeypatch.setattr(pii, "_AT_GATE", Always())
    monkeypatch.setattr(pii, "_NUMBER_GATE", Always())
    assert pii.find(text) == got
    assert pii.find(f"{text} ; two phones")[1][kind] == got[1][kind]


def test_no_part_of_a_url_is_left_out():
    host = "a.b.c.d.e.f.example.org"
    base = f"https://{host}/1/2/3/4/5.html?a=1&b=2&c=3&d=4&e=5"
    for other in (base.replace("a.b", "z.b"), base.replace("/4/", "/9/"), base.replace("5.html", "6.html"), base.replace("&e=", "&f="), base.replace("e=5", "e=6")):
        assert urls.tokens(base) != urls.tokens(other), other
    long = "http://x.org/" + "p" * 100
    assert urls.tokens(long + "a") != urls.tokens(long + "b") and all(len(t) < 100 for t in urls.tokens(long + "a"))


def test_rules_on_late_parts_of_urls(spark):
    rows = [(i, f"http://x{i}.net/a/b/c/{'bad' if i % 3 == 0 else 'good'}?p=1&q=1&r=1&s=1") for i in range(90)]
    lab = spark.createDataFrame([(u, "block" if "bad" in u else "allow") for _, u in rows], "url string, label string")
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labelled=lab).collect()
    assert len(got) == 90 and all(r["verdict"] == ("block" if r["page_id"] % 3 == 0 else "allow") for r in got)


def kinds(html):
    return [(x["kind"], x["text"] or x["src"], x["caption"]) for x in media.parse(html)]


def test_captions_and_unclosed_tags():
    assert kinds("<figure><figcaption>C</figcaption><img src=a><img src=b></figure>") == [("img", "a", "C"), ("img", "b", "C")]
    assert kinds("<figure><pre>code</pre><figcaption>C</figcaption></figure>x") == [("text", "code", None), ("text", "C", None), ("text", "x", None)]
    assert kinds("<figure><figcaption>C <img src=a> D</figcaption></figure>") == [("img", "a", "C D")]
    assert kinds("<figure><img src=a><figcaption>C") == [("img", "a", "C")]
    assert kinds("<figure><figure><img src=a><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>") == [("img", "a", "in"), ("text", "out", None)]
    assert kinds("<p>a<noscript>b<p>c") == [("text", "ab", None), ("text", "c", None)]
    assert kinds("<p>a<template>b</template><p>c<noscript>d") == [("text", "a", None), ("text", "cd", None)]


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.out = [], False

    def handle_starttag(self, tag, attrs):
        self.out |= tag in ("script", "style")

    def handle_endtag(self, tag):
        self.out &= tag not in ("script", "style")

    def handle_data(self, data):
        if not self.out:
            self.words.append(data)


def test_interleave_keeps_every_letter_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = media.interleave(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        w = Words()
        w.feed(html[r["page_id"]] or "")
        w.close()
        said = "".join(x["text"] for x in r["items"] if x["kind"] == "text")
        assert Counter(re.sub(r"\s", "", said)) == Counter(re.sub(r"\s", "", "".join(w.words)))
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"])))


def test_null_texts_share_a_bin(spark):
    from fringeflow.llm import packing

    docs = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, None, "c")], "doc_id long, text string, source string")
    got = packing.pack_documents(docs).collect()
    assert [r["cluster"] for r in got] == [None] * 3 and len({r["bin_id"] for r in got}) == 1
