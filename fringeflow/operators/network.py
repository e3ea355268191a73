"""Pair networks: which acquisitions to combine, connectivity, design matrices, closure loops."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.components import connected_components
from fringeflow.errors import DimensionMismatch, InvalidNetwork
from fringeflow.operators.cube import Pair, check_epochs

MAX_DAYS, MAX_BASELINE_M = 60, 200.0


def pairs_within(epochs: DataFrame, max_days: int = MAX_DAYS, max_baseline_m: float = MAX_BASELINE_M) -> DataFrame:
    """epochs(epoch_idx, epoch, perp_m) -> pairs within both limits (inclusive), numbered in (ref, sec) order."""
    a = epochs.select(F.col("epoch_idx").alias("ref_idx"), F.col("epoch").alias("e1"), F.col("perp_m").alias("b1"))
    b = F.broadcast(epochs.select(F.col("epoch_idx").alias("sec_idx"), F.col("epoch").alias("e2"), F.col("perp_m").alias("b2")))  # acquisitions: thousands at most
    near = (F.col("ref_idx") < F.col("sec_idx")) & (F.abs(F.datediff("e2", "e1")) <= max_days) & (F.abs(F.col("b2") - F.col("b1")) <= max_baseline_m)
    return a.join(b, near).select("ref_idx", "sec_idx", (F.col("b2") - F.col("b1")).alias("perp_baseline_m"), F.datediff("e2", "e1").alias("dt_days"))


def build_network(epochs: tuple[date, ...], perp_m: list[float], max_days: int = MAX_DAYS, max_baseline_m: float = MAX_BASELINE_M) -> tuple[Pair, ...]:
    """The same on the driver, checked: lengths, order of epochs, and that every epoch is reached."""
    if len(epochs) != len(perp_m):
        raise InvalidNetwork(f"{len(perp_m)} baselines for {len(epochs)} epochs")
    check_epochs(epochs)
    pairs = tuple(Pair(i, j, perp_m[j] - perp_m[i]) for i in range(len(epochs)) for j in range(i + 1, len(epochs)) if (epochs[j] - epochs[i]).days <= max_days and abs(perp_m[j] - perp_m[i]) <= max_baseline_m)
    if not pairs or not is_connected(pairs, len(epochs)):
        raise InvalidNetwork("the network does not connect all epochs")
    return pairs


def components(pairs, n: int) -> list[int] | None:
    """The least epoch that each epoch is connected to; None if a pair is outside 0..n-1."""
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for p in pairs:
        if not (0 <= p.ref < n and 0 <= p.sec < n):
            return None
        a, b = find(p.ref), find(p.sec)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def is_connected(pairs, n: int) -> bool:
    got = components(pairs, n)
    return got is not None and len(set(got)) <= 1


def largest_component(pairs, epochs: tuple[date, ...]) -> tuple[tuple[date, ...], tuple[Pair, ...], list[int]]:
    """Epochs and pairs of the largest component, renumbered, and which pairs those are; ties: the one with the earliest epoch."""
    got = components(pairs, len(epochs))
    if got is None:
        raise InvalidNetwork("a pair is outside the epochs")
    best = max(sorted(set(got)), key=got.count)
    keep = [i for i, g in enumerate(got) if g == best]
    new = {e: k for k, e in enumerate(keep)}
    at = [k for k, p in enumerate(pairs) if p.ref in new and p.sec in new]
    return tuple(epochs[i] for i in keep), tuple(Pair(new[pairs[k].ref], new[pairs[k].sec], pairs[k].perp_baseline_m) for k in at), at


def reachable(pairs: DataFrame) -> DataFrame:
    """(epoch_idx) reachable from the earliest epoch over pairs(ref_idx, sec_idx), however many hops away."""
    first = pairs.agg(F.min("ref_idx").alias("epoch_idx"))
    groups = connected_components(pairs.select("ref_idx", "sec_idx"))
    its = groups.join(first, F.col("node") == F.col("epoch_idx")).select("component")
    kind = dict(pairs.dtypes)["ref_idx"]
    return groups.join(its, "component", "left_semi").select(F.col("node").cast(kind).alias("epoch_idx")).unionAll(first).distinct()


def design_matrix(pairs, n: int) -> np.ndarray:
    """Pairs by increments: 1 for the increments from the pair's reference to its secondary."""
    if n < 2:
        raise InvalidNetwork("at least two epochs are needed")
    a = np.zeros((len(pairs), n - 1))
    for k, p in enumerate(pairs):
        if not 0 <= p.ref < p.sec < n:
            raise InvalidNetwork(f"pair {p.ref}-{p.sec} is outside the {n} epochs")
        a[k, p.ref : p.sec] = 1
    return a


def design_rows(pairs: DataFrame, n: int) -> DataFrame:
    """The same as rows (pair_idx, increment)."""
    return pairs.select("pair_idx", F.explode(F.sequence("ref_idx", F.col("sec_idx") - 1)).alias("increment")).where(F.col("increment") < n - 1)


def closure_loops(pairs: DataFrame) -> DataFrame:
    """pairs(pair_idx, ref_idx, sec_idx) -> a, b, c, ab, bc, ac of every triangle a < b < c, by two equi-joins; of repeated pairs the first counts."""
    one = pairs.groupBy("ref_idx", "sec_idx").agg(F.min("pair_idx").alias("pair_idx"))

    def named(a: str, b: str) -> DataFrame:
        return one.select(F.col("ref_idx").alias(a), F.col("sec_idx").alias(b), F.col("pair_idx").alias(a + b))

    return named("a", "b").join(named("b", "c"), "b").join(named("a", "c"), ["a", "c"]).select("a", "b", "c", "ab", "bc", "ac")


def loop_matrix(pairs) -> np.ndarray:
    """Loops by pairs, +1, +1, -1, in (a, b, c) order."""
    at: dict[tuple[int, int], int] = {}
    for k, p in enumerate(pairs):
        at.setdefault((p.ref, p.sec), k)
    after: dict[int, list[int]] = {}
    for r, s in sorted(at):
        after.setdefault(r, []).append(s)
    rows = []
    for a, b in sorted(at):
        for c in after.get(b, ()):
            if (a, c) in at:
                row = np.zeros(len(pairs))
                row[at[a, b]], row[at[b, c]], row[at[a, c]] = 1, 1, -1
                rows.append(row)
    return np.array(rows).reshape(-1, len(pairs))


def pair_table(spark: SparkSession, pairs, epochs: tuple[date, ...]) -> DataFrame:
    """pair_idx, ref_idx, sec_idx, perp_baseline_m, dt_days."""
    if any(not 0 <= p.sec < len(epochs) for p in pairs):
        raise DimensionMismatch("a pair is outside the epochs")
    rows = [(k, p.ref, p.sec, float(p.perp_baseline_m), (epochs[p.sec] - epochs[p.ref]).days) for k, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "pair_idx int, ref_idx int, sec_idx int, perp_baseline_m double, dt_days int")
