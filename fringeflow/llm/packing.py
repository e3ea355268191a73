"""Best-fit packing of documents into sequences, under conflicts.

A bin holds at most one document of a source and at most one of a duplicate cluster, so at most as
many documents as there are sources: with one source, one. Documents are dealt at random to shards of
bounded size; each shard packs its own, largest first, into the tightest bin that has room and no
conflict. Texts longer than a bin are cut: full pieces are bins of their own, made without any search,
and only the remainder is packed.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.mixing import words
from fringeflow.llm.store import materialize

CAPACITY, SHARD_ROWS = 2048, 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and start of each item, in the order given.

    Bins stand by residual: a bit per residual in use, and below it the bins that have it. The search
    takes the next set bit from the item's size on until a bin there has neither the item's source
    nor its cluster in its bitmaps (-1: no source or cluster, which conflicts with nothing).
    """
    free, by_residual = 0, {}
    has_source, has_cluster = [], []
    bins, starts = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        left, found = free >> size, -1
        residual = size - 1
        while left:
            step = (left & -left).bit_length()
            residual += step
            left >>= step
            for at, b in enumerate(here := by_residual[residual]):
                if not (has_source[b] & s or has_cluster[b] & c):
                    found = b
                    break
            if found >= 0:
                here[at] = here[-1]
                here.pop()
                if not here:
                    free &= ~(1 << residual)
                break
        if found < 0:
            found, residual = len(has_source), capacity
            has_source.append(0)
            has_cluster.append(0)
        has_source[found] |= s
        has_cluster[found] |= c
        bins.append(found)
        starts.append(capacity - residual)
        rest = residual - size
        by_residual.setdefault(rest, []).append(found)
        free |= 1 << rest
    return bins, starts


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """items(doc_id, source, cluster, size) -> where each piece of each row goes.

    Returns doc_id, source, cluster, size, copy (0, 1, ... for rows that are equal), piece, n_words,
    bin_id, bin_start. Null or negative sizes count as 0 and still get a place; null sources and null
    clusters conflict with nothing; equal rows are packed as often as they occur; other columns are
    ignored; an empty table gives an empty table.
    """
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long")
    rows = items.select("doc_id", "source", "cluster", size.alias("size"))
    rows = rows.groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").alias("n"))
    rows = rows.select("doc_id", "source", "cluster", "size", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy"))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    n_words = F.least(F.col("size") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int")
    rows = materialize(rows.withColumn("n_words", n_words), "pieces")
    full, loose = rows.where(F.col("n_words") == capacity), rows.where(F.col("n_words") < capacity)
    key = F.xxhash64("doc_id", "source", "cluster", "size", "copy", "piece")
    name = F.concat_ws("/", F.lit("full"), F.col("doc_id").cast("string"), F.hex(F.xxhash64("source", "cluster", "size")), "copy", "piece")
    full = full.select("*", name.alias("bin_id"), F.lit(0).alias("bin_start"))
    shards = max(1, -(-loose.count() // shard_rows))
    loose = loose.withColumn("shard", F.pmod(key, F.lit(shards)))

    def one(part: pa.Table) -> pa.Table:
        got = part.drop_columns("shard").to_pydict()
        n = part.num_rows
        ids = {c: {x: i for i, x in enumerate(sorted({x for x in got[c] if x is not None}))} for c in ("doc_id", "source", "cluster")}
        place = {c: [ids[c].get(x, -1) for x in got[c]] for c in ids}
        order = sorted(range(n), key=lambda i: (-got["n_words"][i], place["doc_id"][i], got["copy"][i], got["piece"][i], place["source"][i], place["cluster"][i]))
        met = Counter(place["cluster"])  # a cluster of one conflicts with nothing
        bit = {c: i for i, c in enumerate(c for c, k in met.items() if k > 1 and c >= 0)}
        bins, starts = best_fit([got["n_words"][i] for i in order], [place["source"][i] for i in order], [bit.get(place["cluster"][i], -1) for i in order], capacity)
        shard = part["shard"][0].as_py() if n else 0
        out = part.drop_columns("shard").take(pa.array(order, pa.int64()))
        out = out.append_column("bin_id", pa.array([f"{shard}/{b}" for b in bins], pa.string()))
        return out.append_column("bin_start", pa.array(starts, pa.int32()))

    packed = loose.groupBy("shard").applyInArrow(one, full.schema)
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """pack() of docs(doc_id, source, text): sizes in words, and equal texts as duplicate clusters; null texts are in none."""
    cluster = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    return pack(docs.select("doc_id", "source", cluster.alias("cluster"), words(F.col("text")).alias("size")), capacity, shard_rows)
