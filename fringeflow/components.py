"""Connected components of link tables, as joins and minima on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.store import discard, materialize

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_min(edges: DataFrame, least) -> DataFrame:
    """Each edge (a, b) with m, the least of a's neighbours (as `least` sees them) and a itself."""
    mins = edges.groupBy("a").agg(F.least(F.min(least), F.col("a")).alias("m"))
    return edges.join(mins, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the least node reachable.

    Alternates large-star and small-star contraction; each is one minimum per node (combined before
    the shuffle) and one join that Spark may split where a node is hot. Edges with a null end and
    loops are dropped, repeated edges count once, an empty table gives an empty table.
    """
    cols = edges.columns
    e = edges.select(F.col(cols[0]).cast("long").alias("a"), F.col(cols[1]).cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    seen = _signature(e)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_min(both, F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        stars = _with_min(large, F.col("b"))
        small = stars.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(stars.select("a", F.col("m").alias("b")))
        nxt = materialize(small.where("a <> b").distinct(), "edges")
        now = _signature(nxt)
        discard(e)
        e, before, seen = nxt, seen, now
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
