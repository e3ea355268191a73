"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Documents are sorted by (source, size, id) over all partitions; a document's place among its
source's documents times the source's expected copies is the prefix sum of expected copies. One
offset per source, from a hash of its name, is added, and the document is emitted once for each
integer that its step crosses. Sorting by size makes the words taken follow the target closely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fringeflow.llm.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MAX_REPEAT, SEED = (5, 2, 1), 3, "mix-1"
#: Rows of the table of sources up to which it is broadcast.
BROADCAST_SOURCES = 100_000
_WIDE = "decimal(38,0)"


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list[Column], name: str, index: str) -> DataFrame:
    """df sorted over all partitions, with each row's place (from 0) in column `index`.

    Rows that compare equal are spread over partitions too. One range shuffle, and a table of a count
    per partition.
    """
    df = df.withColumn("__tie", F.monotonically_increasing_id())
    parted = df.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, F.col("__tie")).drop("__tie")
    kept = materialize(parted.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))  # a row for each partition
    offsets = counts.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    out = kept.join(F.broadcast(offsets), part == F.col("__p"))
    return out.withColumn(index, F.col("__o") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__p", "__o")


def source_targets(per_source: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> the same with target double and expected double (copies of each document).

    Sources by code point, null last, have the weights in turn. A source whose share exceeds
    max_repeat times its size is held there, and the rest is shared anew until none is above.
    """
    ranked = numbered(per_source, [F.col("source").asc_nulls_last()], "sources", "__k")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__k") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight.cast("long")).drop("__k"), "weights")
    most = (F.col("source_size") * max_repeat).cast(_WIDE)
    first = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = int(first[0] or 0)
    rest, share = total, int(first[1] or 0)
    while share:  # each round holds at least one more source; rest / share only grows
        held = most * F.lit(share).cast(_WIDE) < F.col("weight").cast(_WIDE) * F.lit(rest).cast(_WIDE)
        row = ranked.agg(F.sum(F.when(held, most)), F.sum(F.when(~held, F.col("weight")))).first()
        now = total - int(row[0] or 0), int(row[1] or 0)
        if now == (rest, share):
            break
        rest, share = now
    if not share:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("expected"))
    free = (F.lit(rest).cast("long") * F.col("weight")).cast("double") / F.lit(float(share))
    target = F.when(held, (F.col("source_size") * max_repeat).cast("double")).otherwise(free)
    expected = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return ranked.select("source", "source_size", target.alias("target"), expected.alias("expected"))


def with_copies(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """docs(doc_id, source, size, ...) with __source_size, __target, __copies.

    The number of copies depends on (source, size, doc_id) and the seed alone; rows equal in all
    three share theirs out in any order. Documents without words count as size 0 and take nothing;
    a null source is a source of its own, null ids come first; an empty table gives an empty table.
    """
    rows = numbered(docs, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")], "ordered", "__i")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("__i").alias("__first"))
    per = materialize(per, "per_source")
    targets = source_targets(per.select("source", "source_size"), weights, max_repeat)
    targets = materialize(targets.join(per.select(F.col("source").alias("__s"), "__first"), F.col("source").eqNullSafe(F.col("__s"))).drop("source"), "targets")
    targets = targets.withColumnsRenamed({"source_size": "__source_size", "target": "__target", "expected": "__expected"})
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit("#" + seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    place = (F.col("__i") - F.col("__first")).cast("double")
    upto = F.floor((place + 1) * F.col("__expected") + offset) - F.floor(place * F.col("__expected") + offset)
    out = rows.join(targets, F.col("source").eqNullSafe(F.col("__s")))
    return out.withColumn("__copies", F.least(upto, F.lit(max_repeat)).cast("long")).drop("__i", "__s", "__first", "__expected")


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, repeats counted."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    out = with_copies(materialize(sized, "sizes"), **kw)
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs (doc_id, source, text and any others), each as often as the mix takes it."""
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), "doc_id", "source", words(F.col(text_col)).alias("size"))
    out = with_copies(rows, **kw).where("__copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")


def oracle(table: str) -> str:
    """DuckDB SQL for mixture() over `table`."""
    cycle = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {table}),
s AS (SELECT source, sum(size)::HUGEINT AS n FROM d GROUP BY source),
k AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {cycle} END)::HUGEINT AS w FROM s),
b AS (SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum({MAX_REPEAT} * n) OVER (ORDER BY n::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  coalesce(sum(w) OVER (ORDER BY n::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw FROM k),
h AS (SELECT *, {MAX_REPEAT} * n * (all_w - cw) < (total - c) * w AS held FROM b),
r AS (SELECT max(total) - coalesce(sum({MAX_REPEAT} * n) FILTER (held), 0) AS rest, sum(w) FILTER (NOT held) AS share FROM h),
t AS (SELECT source, n, CASE WHEN held THEN ({MAX_REPEAT} * n)::DOUBLE ELSE (rest * w)::DOUBLE / share::DOUBLE END AS target,
  ('0x' || substr(md5(coalesce(source, '') || '#{SEED}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM h, r),
p AS (SELECT d.doc_id, d.size, d.source, (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1)::DOUBLE AS i FROM d)
SELECT p.doc_id, p.size, t.n::BIGINT AS source_size, t.target,
  (least(floor((p.i + 1) * e.x + t.u) - floor(p.i * e.x + t.u), {MAX_REPEAT}))::BIGINT * p.size AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source, LATERAL (SELECT CASE WHEN t.n > 0 THEN t.target / t.n::DOUBLE ELSE 0.0 END AS x) e
"""
