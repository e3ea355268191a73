"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

A window on one direction holds a fixed share of all vectors, however many there are. So vectors are
first dealt to cells: a tour cuts them on one random direction after another, near the median but where
few lie, until a cell holds about BLOCK vectors, and there are as many tours, each on directions of its own, as a pair
at the threshold needs to share a cell of one of them with the recall asked for. Both numbers follow
from the table's size and a bounded sample. Within a cell each direction's projections are sorted,
each vector is the centre of a window on every sorted list, a pair's collisions are counted, and pairs
that reach a count calibrated for the recall are verified by their cosine in double precision.

Windows are sets of bits: a sorted list keeps, for each place, the set of vectors before it, a window
is the difference of two such sets, and collisions of all pairs are counted bit by bit at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, comb, erfc, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.components import connected_components
from fringeflow.llm.simhash import merge_labels
from fringeflow.llm.store import materialize

#: Vectors of a cell that cuts aim at; a cell of more than twice as many is dealt to tasks as pairs of its parts.
BLOCK = 2048
#: Sorted directions within a cell, half windows on them in standard deviations of a pair at the threshold, and the recall that the count is set for.
DIRECTIONS, SIGMAS, RECALL = 24, 2.0, 0.9975
#: Share of pairs at the threshold within two standard deviations on one direction.
COLLIDES = 0.9545
#: Share of pairs at the threshold that may share no cell, tours at most, and rows and bytes of the sample that cuts are chosen on.
MISSED, MAX_TOURS, SAMPLE_ROWS, SAMPLE_BYTES = 0.01, 64, 20_000, 1 << 24
_VERIFY = 1 << 16
_GRID = np.linspace(0, 8, 1601)
_TAIL = np.array([0.5 * erfc(x / sqrt(2)) for x in _GRID])


def directions(dim: int, count: int = DIRECTIONS, seed: int = 7) -> np.ndarray:
    """Unit vectors as columns, orthogonal in groups of dim."""
    rng = np.random.default_rng([seed, dim])
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.hstack(parts)[:, :count]


def least_count(n: int, p: float = COLLIDES, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall` in n directions."""
    tail, k = 0.0, n
    while k > 0:
        tail += comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            return k
        k -= 1
    return 0


def spread(dim: int, threshold: float) -> float:
    """Standard deviation, on one direction, of the difference of two unit vectors at the threshold."""
    return sqrt(max(2 - 2 * threshold, 0) / dim)


def _crossing(distance: np.ndarray) -> np.ndarray:
    """Probability that a standard normal deviation exceeds each distance."""
    return np.interp(np.abs(distance), _GRID, _TAIL)


def sparse_cut(at: np.ndarray, sigma: float) -> tuple[float, float]:
    """Where a direction is cut, and by how many bits that lessens the pairs within a side: the place that parts the fewest partners a bit."""
    places = np.quantile(at, np.linspace(0.1, 0.9, 33))
    parted = np.array([_crossing((at - c) / sigma).mean() for c in places])
    below = np.array([(at <= c).mean() for c in places])
    bits = np.maximum(-np.log2(below**2 + (1 - below) ** 2), 1e-9)
    best = np.argmin((parted + 1e-4) / bits)
    return places[best], bits[best]


def plan_tours(sample: np.ndarray, n: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tour its directions (dim, cuts) and where each is cut, for n unit vectors of which `sample` are some.

    A vector at distance d from a cut loses a partner at the threshold with the probability that a normal
    deviation exceeds d. Tours are added until the sample's vectors lose MISSED of such partners on all
    tours; if more than MAX_TOURS were needed, there are fewer cuts and cells are larger.
    """
    dim = sample.shape[1]
    sigma = max(spread(dim, threshold), 1e-12)
    for wanted in range(max(0, ceil(log2(max(n, 1) / BLOCK))), 0, -1):
        tours, missed = [], np.ones(len(sample))
        for t in range(MAX_TOURS):
            axes, places, bits = directions(dim, 31, seed=11 + t), [], 0.0
            at = sample @ axes
            while bits < wanted and len(places) < 31:
                place, more = sparse_cut(at[:2000, len(places)], sigma)
                places.append(place)
                bits += more
            used = len(places)
            tours.append((axes[:, :used], np.array(places)))
            missed *= 1 - np.prod(1 - _crossing((at[:, :used] - tours[-1][1]) / sigma), axis=1)
            if missed.mean() <= MISSED:
                return tours
    return [(np.zeros((dim, 0)), np.zeros(0))]


def cells_of(units: np.ndarray, tours: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(vectors, tours): the cell of each vector on each tour."""
    return np.stack([(units @ axes > places) @ (1 << np.arange(len(places), dtype=np.int64)) for axes, places in tours], axis=1).astype(np.int32)


def _encoded(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, key, v): the vector's numbers as bytes, and their digest; null where it can link with nothing."""
    kind = "<f4" if "float" in dict(vectors.dtypes)[vec_col] else "<f8"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                a = None if not x or None in x else np.array(x, "<f8")
                out.append(a.astype(kind).tobytes() if a is not None and np.isfinite(a).all() and 0 < a @ a < np.inf else None)
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["vec_id", "key", "v"])

    number = "array<float>" if kind == "<f4" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(number))
    return rows.mapInArrow(encode, f"vec_id {dict(vectors.dtypes)[id_col]}, key binary, v binary")


def _units(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def collisions(base: np.ndarray, query: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, base) within half of each other on `least` columns or more; columns are directions."""
    n, width = len(base), -(-len(base) // 64)
    planes = max(1, (base.shape[1]).bit_length())
    full = ~np.uint64(0)
    start = (1 << planes) - least  # a counter that starts here overflows at `least`
    count = [np.full((len(query), width), full if start >> k & 1 else np.uint64(0)) for k in range(planes)]
    hit = np.zeros((len(query), width), np.uint64)
    place = np.arange(1, n + 1)
    for col_b, col_q in zip(base.T, query.T, strict=True):
        order = np.argsort(col_b, kind="stable")
        before = np.zeros((n + 1, width), np.uint64)
        before[place, order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
        np.bitwise_or.accumulate(before, axis=0, out=before)
        ranked = col_b[order]
        carry = before[np.searchsorted(ranked, col_q + half, "right")] ^ before[np.searchsorted(ranked, col_q - half, "left")]
        for c in count:
            c ^= carry
            carry &= ~c  # the bit was set, and is not any more
        hit |= carry
    q, word = np.nonzero(hit)
    row, bit = np.nonzero(np.unpackbits(hit[q, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[row], word[row] * 64 + bit


def pairs_in(base: np.ndarray, query: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, base) of unit vectors with cosine >= threshold, by collision counts; without `query` the pairs within base, once each."""
    dim, same = base.shape[1], query is None
    axes = directions(dim)
    other = base if same else query
    pb = base @ axes
    pq = pb if same else query @ axes
    half = SIGMAS * spread(dim, threshold) + 1e-9
    step = max(64, (1 << 23) // max(64, len(base)))
    for s in range(0, len(other), step):
        i, j = collisions(pb, pq[s : s + step], half, least_count(DIRECTIONS))
        i = i + s
        if same:
            i, j = i[j > i], j[j > i]
        for t in range(0, len(i), _VERIFY):
            x, y = i[t : t + _VERIFY], j[t : t + _VERIFY]
            near = np.einsum("ij,ij->i", other[x], base[y]) >= threshold
            yield x[near], y[near]


def _linked(group: pa.Table, kind: str, threshold: float) -> pa.Table:
    """Of one cell, or two parts of one: for each vector that has links, how many rows they lead to, and the head of its local component.

    A pair that shares a cell of an earlier tour was counted there.
    """
    role, tour = group["role"].to_numpy(), group["tour"][0].as_py()
    base, query = group.filter(pa.array(role == 0)), group.filter(pa.array(role == 1))
    same = not query.num_rows
    ids, n = base["did"].to_numpy(), base["n"].to_numpy()
    cells = np.array(base["cells"].to_pylist(), np.int64).reshape(base.num_rows, -1)[:, :tour]
    own = cells
    if not same:
        own = np.array(query["cells"].to_pylist(), np.int64).reshape(query.num_rows, -1)[:, :tour]
        ids, n = np.concatenate([ids, query["did"].to_numpy()]), np.concatenate([n, query["n"].to_numpy()])
    shift = 0 if same else base.num_rows
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    if base.num_rows:
        for q, b in pairs_in(_units(base["v"], kind), None if same else _units(query["v"], kind), threshold):
            new = ~(own[q] == cells[b]).any(axis=1)
            q, b = q[new] + shift, b[new]
            np.add.at(links, q, n[b])
            np.add.at(links, b, n[q])
            merge_labels(label, q, b)
    met = links > 0
    return pa.table({"did": pa.array(ids[met]), "links": pa.array(links[met]), "head": pa.array(ids[label[met]])})


def _links_of(distinct: DataFrame, dim: int, kind: str, threshold: float) -> DataFrame:
    """(did, links, head) for the distinct vectors of one dimension; a vector has a row for each cell where it links."""
    n = distinct.count()
    share = min(SAMPLE_ROWS, max(256, SAMPLE_BYTES // (8 * dim))) / max(n, 1)
    some = distinct.where(F.pmod(F.xxhash64("did"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("v").toArrow()
    some = _units(some["v"], kind) if some.num_rows else np.zeros((1, dim))
    tours = plan_tours(some, n, threshold)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = cells_of(_units(b.column("v"), kind), tours)
                yield b.append_column("cells", pa.array(list(cells), pa.list_(pa.int32())))

    toured = materialize(distinct.select("did", "n", "v").mapInArrow(visit, "did long, n long, v binary, cells array<int>"), "toured")
    dealt = toured.select("*", F.posexplode("cells").alias("tour", "cell"))
    full = dealt.groupBy("tour", "cell").agg(F.count("*").alias("k")).where(F.col("k") > 2 * BLOCK)
    full = materialize(full.select("tour", "cell", F.ceil(F.col("k") / (2 * BLOCK)).cast("int").alias("parts")), "full_cells")
    dealt = dealt.join(full, ["tour", "cell"], "left")  # by Spark's choice of join: small unless very many cells are full
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("did"), F.coalesce("parts", F.lit(1))).cast("int"))
    later = F.transform(F.sequence("own", F.coalesce("parts", F.lit(1)) - 1), lambda j: F.struct(F.col("own").alias("a"), j.alias("b"), F.lit(0).alias("role")))
    earlier = F.transform(F.filter(F.sequence(F.lit(0), "own"), lambda i: i < F.col("own")), lambda i: F.struct(i.alias("a"), F.col("own").alias("b"), F.lit(1).alias("role")))
    dealt = dealt.select("did", "n", "v", "cells", "tour", "cell", F.explode(F.concat(later, earlier)).alias("x")).select("did", "n", "v", "cells", "tour", "cell", "x.*")

    def join(group: pa.Table) -> pa.Table:
        if group["a"][0].as_py() != group["b"][0].as_py() and len(set(group["role"].to_pylist())) < 2:
            return group.select(["did"]).append_column("links", group["did"]).append_column("head", group["did"]).slice(0, 0)
        return _linked(group, kind, threshold)

    return dealt.groupBy("tour", "cell", "a", "b").applyInArrow(join, "did long, links long, head long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors link only with those of their own length. Equal vectors are compared once and count as
    often as they occur. Rows keep a row each even where ids repeat; other columns are ignored; an
    empty table gives an empty table. No link below the threshold is made; of pairs just at it at most
    about MISSED + (1 - RECALL) are missed, fewer above, none in a table of one cell but by the count.
    """
    kind = "<f4" if "float" in dict(vectors.dtypes)[vec_col] else "<f8"
    rows = materialize(_encoded(vectors, id_col, vec_col), "vectors")
    distinct = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    distinct = materialize(distinct.withColumn("did", F.monotonically_increasing_id()), "distinct")
    size = int(kind[2])
    lengths = sorted(r[0] // size for r in distinct.select(F.length("v")).distinct().collect())
    found = None
    for dim in lengths:
        part = _links_of(distinct.where(F.length("v") == dim * size).select("v", "did", "n"), dim, kind, threshold)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "did long, links long, head long")
    found = materialize(found, "links")
    groups = connected_components(found.select("did", "head"))
    of = distinct.select("key", "did", "n", "least").join(found.groupBy("did").agg(F.sum("links").alias("links")), "did", "left")
    of = of.join(groups.withColumnRenamed("node", "did"), "did", "left").withColumn("component", F.coalesce("component", "did"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(ids, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    told = rows.where(F.col("key").isNotNull()).select("vec_id", "key").join(of, "key").select("vec_id", "links", "component_id")
    alone = rows.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    out = told.unionByName(alone)
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
