"""URL filters: stated rules first, and association rules mined by FP-growth for the rest.

A URL becomes a small set of tokens (scheme, domain parts, path words, query names). FP-growth mines
the token combinations that go with a label; rules that a shorter one with at least their confidence
covers are pruned; the remaining rules stand in an inverted index under their rarest token.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.store import materialize

# The stated rules, (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: Labelled rows that a rule has to fit at least, however few there are.
LEAST_ROWS = 5
#: How far a mined rule's share of its label must be from that of all labelled rows: chi-squared of one degree of freedom, exceeded by chance once in a thousand.
LEAST_CHI2 = 10.83
#: Verdict of a URL that no rule matches.
DEFAULT = "allow"
LABEL = "label="
#: Longest value that stands in a token as it is.
LONG = 64

_SPLIT = re.compile(r"^([^/?#]*?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", re.DOTALL)
_WORDS = re.compile(r"[^0-9A-Za-z]+")
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without :// or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, *_AZ), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as `host/path`, and its verdict; null where none fits. A rule fits its host and all subdomains."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _short(value: str) -> str:
    """The value, or a digest of one that is long."""
    return value if len(value) <= LONG else "sha256:" + hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def tokens(url: str | None) -> list[str]:
    """Tokens of the whole URL: scheme, every host label and the words of hyphenated ones, every path step and ending, every query name and argument, fragment."""
    m = _SPLIT.match(url or "")
    if not m:
        return []
    scheme, host, path, query, fragment = m.groups()
    labels = [x for x in host.lower().split(".") if x]
    out = {f"scheme={_short(scheme.lower())}"}
    for i, x in enumerate(labels[::-1]):
        out.add(f"host{i}={_short(x)}")
    out.update(f"word={_short(w)}" for x in labels if "-" in x for w in _WORDS.split(x) if w)
    steps = [x for x in path.split("/") if x]
    for i, x in enumerate(steps):
        stem, dot, ending = x.lower().partition(".")
        out.add(f"path{i}={_short(stem)}")
        if stem.isdigit():
            out.add(f"path{i}=#")
        if dot:
            out.add(("ending=" if i == len(steps) - 1 else f"ending{i}=") + _short(ending))
    for q in query[1:].split("&") if query else ():
        name, given, _ = q.partition("=")
        if q:
            out.add("query=" + _short(name))
        if given:
            out.add("argument=" + _short(q))
    if fragment:
        out |= {"fragment", "fragment=" + _short(fragment[1:])}
    return sorted(out)


def told_by(rule: str) -> tuple[frozenset[str], str]:
    """Of a rule `host/path` the tokens that a URL has because the rule fits it, and the beginning of those of a step that it cuts short."""
    host, _, path = rule.partition("/")
    *steps, rest = path.split("/")
    out = {f"host{i}={x}" for i, x in enumerate(host.split(".")[::-1])} | {f"path{i}={x}" for i, x in enumerate(steps)}
    return frozenset(out), f"path{len(steps)}=" if rest else ""


def with_tokens(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with a column __tokens."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    place = urls.columns.index(url_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("__tokens", pa.array([tokens(u) for u in b.column(place).to_pylist()], pa.list_(pa.string())))

    return urls.mapInArrow(read, StructType([*urls.schema.fields, StructField("__tokens", ArrayType(StringType()))]))


def pruned(rules: list[tuple[tuple[str, ...], str, float, float]]) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Rules (tokens, label, confidence, support) without those that a rule on fewer of their tokens covers with no less confidence."""
    kept: list = []
    by_token: dict[tuple[str, str], list] = defaultdict(list)
    for r in sorted(rules, key=lambda r: (len(r[0]), r[0], r[1])):
        items = set(r[0])
        if any(k[2] >= r[2] and items.issuperset(k[0]) for t in r[0] for k in by_token[t, r[1]]):
            continue
        kept.append(r)
        by_token[r[0][0], r[1]].append(r)
    return kept


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least_rows: int = LEAST_ROWS, least_chi2: float = 0.0) -> tuple[list[tuple[tuple[str, ...], str, float, float]], dict[str, str]]:
    """Rules from labelled(__tokens, label), and for each frequent token the one that stands for it in the rules.

    A rule fits min_support of the rows and least_rows rows at least, and says more than the labels' own shares do: its label is commoner
    among its rows than among all, by chi-squared least_chi2 at least (0: any rule of enough confidence). Rows with a null label or without tokens
    teach nothing; no rows, no rules. How many rules there can be depends on the support asked for and the
    tokens of a URL, not on the number of URLs.
    """
    items = labelled.where(F.col("label").isNotNull() & (F.size("__tokens") > 0))
    shares = {x["label"]: x["count"] for x in items.groupBy("label").count().collect()}
    rows = sum(shares.values())
    if rows < least_rows or not rows:
        return [], {}
    min_support = max(min_support, (least_rows - 0.5) / rows)
    # Tokens below the support are in no frequent rule. Of tokens that occur in exactly the same rows one stands for
    # all, and tokens of all rows add nothing to a longer rule: rules that use more of them would be pruned below.
    told = items.withColumn("row", F.xxhash64(F.monotonically_increasing_id()).cast("decimal(20,0)")).select("row", F.explode("__tokens").alias("t"))
    often = told.groupBy("t").agg(F.count("*").alias("n"), F.sum("row").alias("where")).where(F.col("n") >= min_support * rows)
    alike: dict = defaultdict(list)
    for x in often.collect():  # at most a URL's tokens / min_support
        alike[x["n"], x["where"]].append(x["t"])
    same = {t: min(ts) for ts in alike.values() for t in ts}
    everywhere = {min(ts) for (n, _), ts in alike.items() if n == rows}
    bare = [((t,), label, n / rows, n / rows) for t in everywhere for label, n in shares.items() if n / rows >= min_confidence and n / rows >= min_support]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [sorted({same[t] for t in ts if t in same} - everywhere) + [LABEL + label] for ts, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.string()))], ["items"])

    items = items.select("__tokens", "label").mapInArrow(thin, "items array<string>")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL))
    rules = bare + [(tuple(sorted(r["antecedent"])), r["consequent"][0][len(LABEL) :], r["confidence"], r["support"]) for r in found.collect()]
    if least_chi2 > 0:
        rules = [r for r in rules if r[2] > shares[r[1]] / rows and chi_squared(round(r[3] * rows), round(r[3] * rows / r[2]), shares[r[1]], rows) >= least_chi2]
    return pruned(rules), same


def chi_squared(both: int, fits: int, label: int, rows: int) -> float:
    """Of the table of rows that a rule fits or not and that have the label or not."""
    margins = fits * (rows - fits) * label * (rows - label)
    return rows * (both * rows - fits * label) ** 2 / margins if margins else 0.0


class Index:
    """Rules under their rarest token: a URL looks only at the rules of its own tokens."""

    def __init__(self, rules: list):
        often: dict[str, int] = defaultdict(int)
        for r in rules:
            for t in r[0]:
                often[t] += 1
        self.under = defaultdict(list)
        for r in rules:
            self.under[min(r[0], key=lambda t: (often[t], t))].append((frozenset(r[0]), r[1], r[2], r[3]))

    def best(self, toks: list[str]) -> str | None:
        """Label of the rule that match() finds."""
        got = self.match(toks)
        return got and got[0]

    def match(self, toks: list[str]) -> tuple[str, frozenset[str]] | None:
        """Label and tokens of the matching rule of the most confidence, then support, then tokens; ties by label."""
        have, top = set(toks), None
        for t in toks:
            for items, label, confidence, support in self.under.get(t, ()):
                if items <= have:
                    rank = (confidence, support, len(items), label, sorted(items))
                    if top is None or rank > top[0]:
                        top = rank, items
        return top and (top[0][3], top[1])


def judge(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, **kw) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for every row of pages; mined is the tokens of the mined rule that gave the verdict, else null.

    Association rules are mined from labelled(url, label) or, if that is not given, from the pages
    that the stated rules decide, all of them without the tokens that any stated rule speaks of: what is mined says
    what else goes with a verdict, and neither restates the rules nor turns them round. A null url, or one without ://, has an empty host and path, fits no
    rule and gets DEFAULT; repeated rows keep a row each; other columns are ignored.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    seen = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    seen = materialize(with_tokens(seen.withColumn("rule", name).withColumn("stated", verdict)), "urls")
    if labelled is None:
        told = {h + p: told_by(h + p) for _, h, p in rules}
        every = F.array_except("__tokens", F.array(*map(F.lit, sorted(set().union(*(whole for whole, _ in told.values()))))))
        for rule, (_, cut) in told.items():
            if cut:  # a step that the rule says the beginning of
                every = F.filter(every, lambda t, begins=cut + rule.rpartition("/")[2]: ~t.startswith(begins))
        taught = every
        for rule, (_, cut) in told.items():
            if cut:
                taught = F.when(F.col("rule") == rule, F.filter(every, lambda t, cut=cut: ~t.startswith(cut))).otherwise(taught)
        taught = seen.where(F.col("stated").isNotNull()).select(taught.alias("__tokens"), F.col("stated").alias("label"))
    else:
        taught = with_tokens(labelled.select("url", "label"))
    mined, same = mine(taught, **({"least_chi2": LEAST_CHI2} | kw))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(mined)
        for b in batches:
            verdicts, why = [], []
            for v, t in zip(b.column("stated").to_pylist(), b.column("__tokens").to_pylist(), strict=True):
                got = None if v else index.match(sorted({same[x] for x in t or () if x in same}))
                verdicts.append(v or (got[0] if got else DEFAULT))
                why.append(" ".join(sorted(got[1])) if got else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(why, pa.string())], ["page_id", "host", "path", "rule", "verdict", "mined"])

    return seen.mapInArrow(match, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string, mined string")
