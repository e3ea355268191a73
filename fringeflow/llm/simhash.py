"""SimHash near-dedup with a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint; distinct fingerprints are routed so that any two that
differ in at most `max_bits` bits meet in at least one group, and each task joins its groups with an
index built in Gray order: sorted fingerprints, upper nodes holding the bit pattern that all of
their members share, differences accumulated on the way down and whole nodes pruned (or linked)
at once. A group shares all bits but two blocks', so it can never hold more than 2**22
fingerprints however the data look.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.components import connected_components
from fringeflow.llm.store import drop_path, materialize, new_path

#: Fan-out of the index and how many (query, node) pairs are held at once.
FAN, FRONTIER = 8, 1 << 20
#: Shingle hashes that are counted at once.
CHUNK = 1 << 16
#: Pairs that are compared by whole sets before what they link is made use of.
COMPARED = 1 << 10
#: What keep_one takes as near copies: Jaccard similarity of shingles of so many words.
WIDTH, SIMILARITY = 5, 0.8
#: Share of bits in which fingerprints at that similarity differ (a cosine of 0.89), and how many differing bits of 64 a candidate may have (exceeded by one pair in a hundred there).
NEAR_FLIP, RADIUS = 0.151, 17
#: The same for that fingerprint and a second one together, of 128 bits (exceeded by one pair in two thousand there).
RADIUS_BOTH = 33
#: Slots of a text's sketch (four bits of the least of the shingle hashes that fall to each: one of KINDS, 0 where none does), and by how many deviations a pair's equal slots may be fewer than at SIMILARITY.
SLOTS, KINDS, SKETCH_SIGMAS = 512, 15, 2.6
#: The routes are split in so many shares; on each in turn near copies are linked to a hub, before all other pairs are asked for.
HUB_SHARES = 2
#: An odd number by which masked codes are spread.
MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)
#: Share of the different shingles that so many filled slots show, by the mean number that fills as many; none where all are filled.
_SHOWN = np.r_[1.0, -np.arange(1, SLOTS) / SLOTS / np.log1p(-np.arange(1, SLOTS) / SLOTS), 0.0]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    b = hashes.view(np.uint8).reshape(-1, 8)
    if len(b) <= 200:
        return np.unpackbits(b, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    per_byte = np.bincount((b + _LANES).ravel(), minlength=2048).reshape(8, 256)
    return (per_byte @ _BYTE_BITS).ravel()


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer; 0 for a text without words or null."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    joined = b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    starts, ends = at[:n].tolist(), (at[width:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        h = [digest(joined[s:e], seed) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)]
        counts += _bit_counts(np.array(h, np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def sketched(text: bytes | None, width: int) -> tuple[int, int, bytes]:
    """Two independent SimHashes of a text's shingles, from the halves of their 128-bit hashes, and its sketch, two slots a byte."""
    words = text.lower().split() if text else []
    if not words:
        return 0, 0, bytes(SLOTS // 2)
    width = min(width, len(words))
    joined = b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    n, digest = len(words) - width + 1, xxhash.xxh3_128_digest
    starts, ends = at[:n].tolist(), (at[width:] - 1).tolist()
    counts, least = np.zeros((2, 64), np.int64), np.full(SLOTS, ~np.uint64(0))
    for k in range(0, n, CHUNK):
        h = b"".join([digest(joined[s:e]) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)])
        halves = np.ascontiguousarray(np.frombuffer(h, np.uint64).reshape(-1, 2).T)
        for c, half in zip(counts, halves, strict=True):
            c += _bit_counts(half)
        np.minimum.at(least, halves[0] % np.uint64(SLOTS), halves[0] >> np.uint64(16))
    slots = np.where(least == ~np.uint64(0), 0, 1 + least % np.uint64(KINDS)).astype(np.uint8)
    sketch = slots[: SLOTS // 2] | slots[SLOTS // 2 :] << 4
    first, second = (int(np.packbits(2 * c > n, bitorder="little").view("<i8")[0]) for c in counts)
    return first, second, sketch.tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """If rows of two matrices of sketches have as many equal slots as texts of that similarity have but for one pair in two hundred.

    The slots that either text fills show as many of both texts' shingles, each once: of short texts nearly all,
    so that little is left to chance but unequal shingles of equal bits.
    """
    either, both, equal = 0, 0, 0
    for x, y in ((a & 15, b & 15), (a >> 4, b >> 4)):
        either = either + ((x | y) > 0).sum(axis=1)
        both = both + ((x > 0) & (y > 0)).sum(axis=1)
        equal = equal + ((x == y) & (x > 0)).sum(axis=1)
    same = (equal * KINDS - both) / (KINDS - 1)  # without those that are equal by chance
    chance = least * (1 - least) * (1 - _SHOWN[either]) * either + np.maximum(both - least * either, 0) / (KINDS - 1)
    return same >= least * either - SKETCH_SIGMAS * np.sqrt(chance)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row of docs; null and wordless texts get 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(hashed, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; label holds the least member known of each one's set."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        low = np.minimum(ra, rb)
        np.minimum.at(label, ra, low)
        np.minimum.at(label, rb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class GrayIndex:
    """Levels of nodes over codes sorted by (group, Gray rank). A node: the bits that its members share."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.codes, self.group = codes, group
        n = len(codes)
        first = np.arange(n)
        self.levels = [{"low": codes, "high": codes, "first": first, "last": first, "group": group}]
        while True:
            below = self.levels[-1]
            g = below["group"]
            head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[head, len(g)])
            if size.max(initial=1) == 1:
                break
            place = np.arange(len(g)) - np.repeat(head, size)
            start = np.flatnonzero(place % FAN == 0)
            end = np.r_[start[1:], len(g)]
            self.levels.append({
                "low": np.bitwise_and.reduceat(below["low"], start), "high": np.bitwise_or.reduceat(below["high"], start),
                "first": below["first"][start], "last": below["last"][end - 1], "group": g[start], "child": start, "end": end,
            })

    def shared(self, k: int) -> np.ndarray:
        x = self.levels[k]
        return ~(x["low"] ^ x["high"])

    def labels(self, max_bits: int) -> np.ndarray:
        """For each code the least index of a code that links of at most max_bits bits lead to, within its group."""
        n = len(self.codes)
        label = np.arange(n)
        masks = [self.shared(k) for k in range(len(self.levels))]
        for k in range(1, len(self.levels)):  # members that differ in few bits all link to each other
            x = self.levels[k]
            tight = np.bitwise_count(~masks[k]) <= max_bits
            if tight.any():
                spans = x["last"][tight] - x["first"][tight] + 1
                heads = np.repeat(x["first"][tight], spans)
                merge_labels(label, heads, heads + np.arange(len(heads)) - np.repeat(np.cumsum(spans) - spans, spans))
        top = len(self.levels) - 1
        root = np.searchsorted(self.levels[top]["group"], self.group)
        zero = np.zeros(n, np.uint8)
        work = [(top, np.arange(s, min(n, s + FRONTIER)), root[s : s + FRONTIER], zero[s : s + FRONTIER], True) for s in range(0, n, FRONTIER)]
        while work:
            k, q, node, acc, fresh = work.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                work += [(k, q[:half], node[:half], acc[:half], fresh), (k, q[half:], node[half:], acc[half:], fresh)]
                continue
            x = self.levels[k]
            if fresh:
                new = masks[k][node]
            else:
                up = self.parents(k)[node]
                new = masks[k][node] & ~masks[k + 1][up]
            acc = acc + np.bitwise_count((self.codes[q] ^ x["low"][node]) & new).astype(np.uint8)
            keep = (acc <= max_bits) & (x["last"][node] > q)
            q, node, acc = q[keep], node[keep], acc[keep]
            if not len(q):
                continue
            whole = acc + np.bitwise_count(~masks[k][node]) <= max_bits
            if whole.any():
                merge_labels(label, q[whole], x["last"][node[whole]])
                q, node, acc = q[~whole], node[~whole], acc[~whole]
            if k and len(q):
                fan = x["end"][node] - x["child"][node]
                at = np.repeat(x["child"][node], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
                work.append((k - 1, np.repeat(q, fan), at, np.repeat(acc, fan), False))
        return label

    def pairs(self, max_bits: int, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All index pairs (i < j) of a group's codes within max_bits bits and of different components, in portions."""
        n = len(self.codes)
        low, high = [component], [component]
        for x in self.levels[1:]:
            low.append(np.minimum.reduceat(low[-1], x["child"]))
            high.append(np.maximum.reduceat(high[-1], x["child"]))
        top, step = len(self.levels) - 1, FRONTIER // FAN
        root = np.searchsorted(self.levels[top]["group"], self.group)
        work = [(top, np.arange(s, min(n, s + step)), root[s : s + step]) for s in range(0, n, step)]
        while work:
            k, q, node = work.pop()
            if len(q) > step:
                half = len(q) // 2
                work += [(k, q[:half], node[:half]), (k, q[half:], node[half:])]
                continue
            x = self.levels[k]
            keep = x["last"][node] > q
            keep &= (low[k][node] != component[q]) | (high[k][node] != component[q])
            keep &= np.bitwise_count((self.codes[q] ^ x["low"][node]) & self.shared(k)[node]) <= max_bits
            q, node = q[keep], node[keep]
            if not len(q):
                continue
            if not k:
                yield q, node
                continue
            fan = x["end"][node] - x["child"][node]
            at = np.repeat(x["child"][node], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
            work.append((k - 1, np.repeat(q, fan), at))

    def parents(self, k: int) -> np.ndarray:
        x = self.levels[k + 1]
        if "of" not in x:
            x["of"] = np.repeat(np.arange(len(x["child"])), x["end"] - x["child"])
        return x["of"]


def _blocks(parts: int) -> list[int]:
    """Masks of `parts` runs of bits that make up the 64."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_links(key: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (code, least linked code) found within the groups of equal key."""
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    many = size[group] > 1
    group, codes = group[many], codes[many]
    if not len(codes):
        return codes, codes
    order = np.lexsort((gray_rank(codes), group))
    group, codes = group[order], codes[order]
    label = GrayIndex(group, codes).labels(max_bits)
    moved = label != np.arange(len(label))
    return codes[moved], codes[label[moved]]


def link_fingerprints(fps: DataFrame, max_bits: int = 2, parts: int | None = None) -> DataFrame:
    """Links (a, b) whose closure joins any two of the distinct fingerprints fps(fp) within max_bits bits.

    Two such codes agree on all but max_bits of `parts` blocks: there is a route for each choice of
    blocks that may differ, and a group for each value of the rest.
    """
    parts = parts or 3 * max_bits
    blocks = _blocks(parts)
    routes = [~sum(blocks[i] for i in free) & ((1 << 64) - 1) for free in combinations(range(parts), max_bits)]
    routed = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(r), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for r, m in enumerate(routes)])).alias("key"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        fp, key = (np.concatenate(x) for x in zip(*got, strict=True))
        a, b = local_links(key, fp.view(np.uint64), max_bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return routed.repartition("key").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """(doc_id, fp long, fingerprint hex, component_id) for every row of docs.

    component_id is the least id reachable over links of at most max_bits differing bits. Null or
    wordless texts have fingerprint zero and link like any other; rows with equal ids keep a row
    each; null ids are never a component's id unless all its ids are null; an empty table gives an
    empty table. Other columns of docs are ignored.
    """
    hashed = materialize(with_fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = hashed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(link_fingerprints(distinct.select("fp"), max_bits))
    of = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    of = of.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(ids, "component").select("fp", "component_id")
    out = hashed.join(of, "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    """The runs of `width` words; of a shorter text all its words; none of a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return set()
    width = min(width, len(words))
    return {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


def similarity(a: set, b: set) -> float:
    """Jaccard; 1 for two empty sets."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _node(text: bytes | None) -> int:
    """A signed hash of the text's words: texts of equal nodes have equal shingles."""
    x = xxhash.xxh64_intdigest(b" ".join(text.lower().split()) if text else b"", 1)
    return x - (1 << 64) if x >> 63 else x


def sampled_routes(n: int, miss: float = 0.01, group: int = 128) -> list[int]:
    """Masks of bits by which n codes are dealt out to groups of about that size, so that a share `miss` of the pairs with NEAR_FLIP of their bits differing misses all routes."""
    bits = max(4, round(np.log2(max(n, 1) / group)))
    count = int(np.ceil(np.log(miss) / np.log(1 - (1 - NEAR_FLIP) ** bits)))
    rng = np.random.default_rng(7)
    return [sum(1 << int(k) for k in rng.choice(64, bits, replace=False)) for _ in range(count)]


def _dealt(nodes: DataFrame, routes: list[int], join, kind: str) -> DataFrame:
    """What join makes of nodes(fp, route, ..) with the rows of a route whose bits agree in one task."""
    mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in routes]), F.col("route").cast("int") + 1)
    return nodes.repartition(F.xxhash64("route", F.col("fp").bitwiseAND(mask))).mapInArrow(join, kind)


class _Met:
    """The rows of a task that meet others on a route, by group in Gray order, and their pairs."""

    def __init__(self, batches: Iterator[pa.RecordBatch], routes: list[int], lists: tuple[str, ...] = ()):
        self.masks, got, held = np.array(routes, np.uint64), [], {c: [] for c in lists}
        for b in batches:
            got.append([b.column(c).to_numpy() for c in ("node", "fp", "fp2", "component", "route")])
            for c in lists:
                held[c] += b.column(c).to_pylist()
        node, fp, fp2, component, route = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 5
        key = (fp.view(np.uint64) & self.masks[route]) * MIX + route.astype(np.uint64)  # groups that met by chance are only compared for nothing
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero(size[group] > 1)
        at = at[np.lexsort((gray_rank(fp[at].view(np.uint64)), group[at]))]
        self.node, self.codes, self.more, self.component, self.route = node[at], fp[at].view(np.uint64), fp2[at].view(np.uint64), component[at], route[at]
        self.index, self.lists = GrayIndex(group[at], self.codes) if len(at) else None, {c: [x[k] for k in at] for c, x in held.items()}
        if "sketch" in self.lists:
            self.sketch = np.frombuffer(b"".join(self.lists.pop("sketch")), np.uint8).reshape(-1, SLOTS // 2)

    def near(self, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different `of` within RADIUS and RADIUS_BOTH bits, in portions."""
        for a, b in self.index.pairs(RADIUS, of) if self.index else ():
            ok = np.bitwise_count(self.codes[a] ^ self.codes[b]) + np.bitwise_count(self.more[a] ^ self.more[b]) <= RADIUS_BOTH
            yield a[ok], b[ok]

    def alike(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of different components whose sketches do not rule the similarity out, each on one route only."""
        for a, b in self.near(self.component):
            first, xor = np.ones(len(a), bool), self.codes[a] ^ self.codes[b]
            for r, m in enumerate(self.masks):  # only the first route that two codes share tells of them
                first &= (r >= self.route[a]) | (xor & m != 0)
            a, b = a[first], b[first]
            for k in range(0, len(a), CHUNK):
                x, y = a[k : k + CHUNK], b[k : k + CHUNK]
                ok = may_be_similar(self.sketch[x], self.sketch[y], least)
                yield x[ok], y[ok]


def _on_routes(nodes: DataFrame, used, *more: str) -> DataFrame:
    return nodes.select("node", "fp", "fp2", "component", *more, F.explode(F.array(*[F.lit(r).cast("smallint") for r in used])).alias("route"))


def _hubs(nodes: DataFrame, routes: list[int], used: range) -> DataFrame:
    """One pair (a, b) at most for each of nodes(node, fp, fp2, component), of those within RADIUS and RADIUS_BOTH bits that share one of the `used` routes and not the component: with the one that has most such others itself.

    In a large group of near copies that is the text most like all of them, so that much of it becomes one
    component by few pairs, and its other pairs are not asked for.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(batches, routes)
        n = len(met.node)
        many, best = np.zeros(n, np.int64), np.full(n, -1)
        for a, b in met.near(np.arange(n)):
            many += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        for a, b in met.near(met.component):
            np.maximum.at(best, a, many[b] << 32 | b)
            np.maximum.at(best, b, many[a] << 32 | a)
        has = best >= 0
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(met.node[has]), pa.array(met.node[best[has] & 0xFFFFFFFF]), pa.array(best[has] >> 32)], ["a", "b", "weight"])

    found = _dealt(_on_routes(nodes, used), routes, join, "a long, b long, weight long")
    found = found.groupBy("a").agg(F.max_by("b", F.struct("weight", "b")).alias("b"))  # of a node's hubs on all routes the greatest
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_candidates(nodes: DataFrame, routes: list[int], least: float) -> DataFrame:
    """(node, route) where one of nodes(node, fp, fp2, component, sketch) has a candidate of another component: within RADIUS and RADIUS_BOTH bits, and alike by the sketches. The pairs are not listed."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(batches, routes, ("sketch",))
        has = np.zeros(len(met.node), bool)
        for a, b in met.alike(least):
            has[a] = has[b] = True
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(met.node[has]), pa.array(met.route[has], pa.int16())], ["node", "route"])

    return _dealt(_on_routes(nodes, range(len(routes)), "sketch"), routes, join, "node long, route smallint")


class _Sets:
    """Sets of shingle hashes, numbered within a task."""

    def __init__(self, sets: list[bytes]):
        self.size = np.array([len(x) // 8 for x in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        values, self.members = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def similar(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Which pairs of sets have that Jaccard similarity at least."""
        order = np.argsort(a, kind="stable")
        both, cut = np.zeros(len(a), np.int64), np.flatnonzero(np.diff(a[order], prepend=-1))
        for s, e in zip(cut, [*cut[1:], len(a)], strict=True):
            at, x = order[s:e], a[order[s]]
            own = slice(self.start[x], self.start[x] + self.size[x])
            self.mark[self.members[own]] = True
            others = b[at]
            ends = np.cumsum(self.size[others])
            here = np.arange(ends[-1]) + np.repeat(self.start[others] - ends + self.size[others], self.size[others])
            total = np.r_[0, np.cumsum(self.mark[self.members[here]])]
            both[at] = total[ends] - total[ends - self.size[others]]
            self.mark[self.members[own]] = False
        return both / np.maximum(self.size[a] + self.size[b] - both, 1) >= least


def _joins(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs, one after the other, join two sets that were apart."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            top[max(x, y)], out[k] = min(x, y), True
    return out


def _linked(nodes: DataFrame, routes: list[int], stored: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs (a, b) of similar texts that join the components of nodes as all similar candidates (see _with_candidates) do.

    Within a route's group every candidate is compared by its whole set of shingle hashes, unless links found
    before have joined its component; a group gives one pair less than it has components at most, however many pairs it has.
    """
    asked = materialize(_with_candidates(nodes, routes, least), "asking")
    texts = stored.select("node", "text").join(asked.select("node").distinct().hint("shuffle_hash"), "node", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.array([xxhash.xxh3_64_intdigest(x) for x in shingles(t, width)], np.uint64).tobytes() for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(batches, routes, ("sketch", "hashes"))
        sets = _Sets(met.lists["hashes"])
        _, first, of = np.unique(met.component, return_index=True, return_inverse=True)
        label = first[of]
        for a, b in met.alike(least):
            for k in range(0, len(a), COMPARED):
                x, y = a[k : k + COMPARED], b[k : k + COMPARED]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                ok = sets.similar(x, y, least)
                x, y = x[ok], y[ok]
                new = _joins(label, x, y)
                merge_labels(label, x[new], y[new])
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array(met.node[x[new]]), pa.array(met.node[y[new]])], ["a", "b"])

    sets = texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(hashed, "node long, hashes binary")
    rows = nodes.join(sets, "node").join(asked, "node").select("node", "fp", "fp2", "component", "sketch", "hashes", "route")
    found = _dealt(rows, routes, join, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@contextmanager
def _bucketed(df: DataFrame, what: str) -> Iterator[DataFrame]:
    """df written in buckets by node, a file a bucket, so that no text moves to be looked up or grouped by it; deleted at the end, also where that is an error."""
    spark, name, path = df.sparkSession, f"{what}_{uuid.uuid4().hex}", new_path(df.sparkSession, what)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.repartition(buckets, "node").write.option("compression", "zstd").option("path", path).bucketBy(buckets, "node").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(spark, path)


def _verified(pairs: DataFrame, stored: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' shingles have at least the similarity asked for; stored(node, text) is bucketed by node."""
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    texts = stored.select("node", "text").join(asked.hint("shuffle_hash"), "node", "left_semi")
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for x in batches:
            out = []
            for b, ta, tb in zip(x.column(1).to_pylist(), x.column(2).cast(pa.large_binary()).to_pylist(), x.column(3).cast(pa.large_binary()).to_pylist(), strict=True):
                if b != last:
                    last, held = b, shingles(tb, width)
                out.append(similarity(shingles(ta, width), held) >= least)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    with _bucketed(texts.groupBy("node").agg(F.first("text").alias("text")), "texts") as held:
        joined = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return materialize(joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "links")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of docs: the least id reachable over pairs of at least that Jaccard similarity of shingles.

    Candidates are found by fingerprints and sketches of the same shingles (see sampled_routes, RADIUS, RADIUS_BOTH
    and SKETCH_SIGMAS for what that may miss) and every link is checked on the texts. Texts without words are equal to each other.
    """

    def hashed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            made = [sketched(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_node(t) for t in texts], pa.int64()), *(pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)), pa.array([x[2] for x in made], pa.binary()), b.column(1)], ["doc_id", "node", "fp", "fp2", "sketch", "text"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    made = rows.mapInArrow(hashed_rows, f"doc_id {dict(docs.dtypes)[id_col]}, node long, fp long, fp2 long, sketch binary, text string")
    with _bucketed(made, "shingled") as hashed:
        return _grouped(hashed, width, least)


def _grouped(hashed: DataFrame, width: int, least: float) -> DataFrame:
    """(doc_id, component_id) for every row of hashed(doc_id, node, fp, fp2, sketch, text)."""
    nodes = hashed.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("fp", "fp2", "sketch")))
    nodes = materialize(nodes, "nodes")
    routes = sampled_routes(nodes.count())
    links, asked, of = None, None, nodes.select("node", "fp", "fp2", "least", F.col("node").alias("component"))
    for hubs in (*(range(k, len(routes), HUB_SHARES) for k in range(HUB_SHARES)), None):
        told = of.select("node", "fp", "fp2", "component")
        if hubs is None:  # on its routes a node without any candidate has no hub: what is left to ask for is among those that had one
            told = materialize(told.join(nodes.select("node", "sketch").join(asked.distinct(), "node", "left_semi"), "node"), "asked")
            routes = sampled_routes(told.count(), 0.003, 256)  # fewer codes need fewer bits to part them, and so fewer routes
        pairs = materialize(_linked(told, routes, hashed, width, least) if hubs is None else _hubs(told, routes, hubs), "pairs")
        met = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
        asked = met if asked is None else asked.unionAll(met)
        more = _verified(pairs, hashed, width, least)
        links = more if links is None else links.unionAll(more)
        groups = connected_components(links)
        of = materialize(of.drop("component").join(groups, "node", "left").select("node", "fp", "fp2", "least", F.coalesce("component", "node").alias("component")), "grouped")
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    out = hashed.select("doc_id", "node").join(of.join(ids, "component").select("node", "component_id"), "node").select("doc_id", "component_id")
    return materialize(out, "similar")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its group of similar texts; all columns as they came.

    Of rows that repeat the same id all stay or go together; rows with a null id stay.
    """
    cls = similar_groups(docs, id_col, text_col).where(F.col("doc_id") != F.col("component_id"))
    gone = cls.select(F.col("doc_id").alias("__gone")).distinct()
    # the same join at any size: ids that are few enough to be broadcast today are not tomorrow
    return docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone["__gone"], "left_anti")
