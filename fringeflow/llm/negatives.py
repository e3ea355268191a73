"""Hard-negative mining: scores of all anchors with all rows as a block matrix product in two dimensions.

Vectors become integers, rows are numbered by id and dealt to blocks of ROWS, anchors to blocks of
ANCHORS, and both are cut into chunks of CHUNK dimensions. Block (i, k) of the anchors meets block
(j, k) of the rows in one task, as in SUMMA's outer-product form; the partial score tiles of all k are
shuffled to (i, j) and added as 64-bit integers. A finished tile gives each anchor's best rows of its
own label; once these are merged over all tiles, each anchor-positive pair is a window of scores, and
the tile gives the best rows of other labels within every window. Anchors are taken PANEL blocks at a
time, so what is shuffled and stored at once grows with the table, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fringeflow.llm.mixing import numbered
from fringeflow.llm.store import discard, materialize

#: Anchors and rows of a tile, dimensions of a chunk, and blocks of anchors taken together.
ANCHORS, ROWS, CHUNK, PANEL = 512, 1024, 32, 8
#: Components are multiplied by this and floored.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's, both ends included.
LOW, HIGH = 50, 95
_OUT = np.iinfo(np.int64).min  # the score of a row that is no candidate


def _narrow(a: np.ndarray) -> tuple[bytes, int]:
    """An integer array's bytes in the narrowest type that holds it, and that type's width."""
    most = max(int(a.max()), -int(a.min()), 0) if a.size else 0
    width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
    return a.astype(f"<i{width}").tobytes(), width


def _wide(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64)


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)


def _packed(rows: DataFrame, block: str, place: str) -> DataFrame:
    """(block, k, label, own, width, m): the rows of a block in order of `place`, one row for each chunk of dimensions.

    Shorter vectors count as padded with zeros; a block has its chunk 0 in any case.
    """

    def pack(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group[place].to_numpy(), kind="stable"))
        lists = group["v"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        dim = max(1, int(lengths.max()))
        full = np.zeros((len(lengths), dim))
        full[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy()
        full = np.floor(SCALE * full)
        if not np.abs(full).max() < 1 << 62:
            raise OverflowError("a component is too large for scores of 64 bits")
        out = []
        for k in range(-(-dim // CHUNK)):
            m, width = _narrow(full[:, k * CHUNK : (k + 1) * CHUNK].astype(np.int64))
            out.append((group[block][0].as_py(), k, group["label"].to_numpy().tobytes(), group["at"].to_numpy().tobytes(), width, m))
        names = [block, "k", "label", "own", "width", "m"]
        return pa.table(dict(zip(names, map(pa.array, zip(*out, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]), strict=True)))

    return rows.groupBy(block).applyInArrow(pack, f"{block} long, k int, label binary, own binary, width int, m binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact; in floating point where no sum can leave its exact range."""
    bound = a.shape[1] * max(map(int, (np.abs(a).max(initial=0), 1))) * max(map(int, (np.abs(b).max(initial=0), 1)))
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    raise OverflowError("scores do not fit 64 bits")


def _multiply(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """One partial tile; of chunk 0 also what a tile has to know of its rows and columns."""
    if not (anchors.num_rows and rows.num_rows):
        one = anchors if anchors.num_rows else rows
        return one.select(["i", "j", "k"]).slice(0, 0).append_column("width", pa.array([], pa.int32())).append_column("tile", pa.array([], pa.binary())).append_column("about", pa.array([], pa.list_(pa.binary())))
    a, b = ({c: t[c][0].as_py() for c in t.column_names} for t in (anchors, rows))
    m, n = (_wide(x["m"], x["width"]).reshape(len(x["own"]) // 8, -1) for x in (a, b))
    both = min(m.shape[1], n.shape[1])  # beyond the shorter one there are only zeros
    tile, width = _narrow(product(m[:, :both], n[:, :both]))
    about = [a["label"], a["own"], b["label"], b["own"]] if a["k"] == 0 else None
    return pa.table({"i": [a["i"]], "j": [a["j"]], "k": pa.array([a["k"]], pa.int32()), "width": pa.array([width], pa.int32()), "tile": pa.array([tile], pa.binary()), "about": pa.array([about], pa.list_(pa.binary()))})


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores but _OUT, the highest first, ties by place."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= least) & (scores != _OUT))
    else:
        at = np.flatnonzero(scores != _OUT)
    return at[np.argsort(-scores[at], kind="stable")[:k]]


_TILES = "i long, a int, first long, positives array<struct<score:long,at:long>>, width int, scores binary"


def _added(positives: int):
    def add(group: pa.Table) -> pa.Table:
        """The tile, a row for each anchor: its best rows of the same label, and the scores of the rows of other labels."""
        head = next(x for x in group["about"].to_pylist() if x is not None)
        label_a, own_a, label_b, own_b = (np.frombuffer(x, np.int64) for x in head)
        total = np.zeros((len(own_a), len(own_b)), np.int64)
        top = 0
        for tile, width in zip(group["tile"], group["width"].to_pylist(), strict=True):
            part = _wide(tile.as_py(), width).reshape(total.shape)
            top += int(np.abs(part).max())
            if top >= 1 << 62:
                raise OverflowError("scores do not fit 64 bits")
            total += part
        out = []
        for a, row in enumerate(total):
            same = label_b == label_a[a]
            mine = best(np.where(same & (own_b != own_a[a]), row, _OUT), positives)
            fits = 4 if top < 1 << 30 else 8
            others = np.where(same, np.iinfo(f"i{fits}").min, row).astype(f"<i{fits}")
            out.append((group["i"][0].as_py(), a, int(own_b[0]), [{"score": int(row[x]), "at": int(own_b[x])} for x in mine], fits, others.tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("score", pa.int64()), ("at", pa.int64())])), pa.int32(), pa.binary()]
        return pa.table(dict(zip(("i", "a", "first", "positives", "width", "scores"), map(pa.array, zip(*out, strict=True), kinds), strict=True)))

    return add


def _within(negatives: int, low: int, high: int):
    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row of a tile and each window of its anchor the best scores within."""
        for b in batches:
            out = []
            for i, a, first, width, scores, windows in zip(*(b.column(c).to_pylist() for c in ("i", "a", "first", "width", "scores", "windows")), strict=True):
                s = np.frombuffer(scores, f"<i{width}").astype(np.int64)
                s = np.where(s == np.iinfo(f"i{width}").min, _OUT, s)
                for w in windows:
                    least, most = -(-low * w["score"] // 100), high * w["score"] // 100
                    if least <= most:
                        for x in best(np.where((s >= least) & (s <= most), s, _OUT), negatives):
                            out.append((i, a, w["rank"], w["at"], w["score"], first + int(x), int(s[x])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(7)], ["i", "a", "rank", "pos_at", "pos_score", "at", "score"])

    return seek


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    id_col: str = "vec_id", vec_col: str = "embedding", panel: int = PANEL,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` says, from the columns vec_id and label, which rows are anchors; `label` replaces the
    table's own. Scores are inner products of floor(256 x). An anchor's positives are its `positives`
    best other rows of its label, and a positive's negatives the `negatives` best rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score; a positive without any
    has no row. Ties go to the smaller id. Rows with a null id, label or vector, or with a null or non-finite component take
    no part; vectors of unequal length count as padded with zeros. Rows that repeat an id are rows of their own, also
    as anchors. Scores beyond 64 bits raise OverflowError. Other columns are not read; an empty table,
    or one without anchors, gives an empty table.
    """
    rows = numbered(_usable(vectors, id_col, vec_col, F.col("label") if label is None else label), [F.col("vec_id")], "vectors", "at")
    rows = materialize(rows.withColumn("j", F.floor(F.col("at") / ROWS)), "rows")
    anchors = materialize(numbered(rows.where(anchor), [F.col("vec_id")], "anchors", "place").withColumn("i", F.floor(F.col("place") / ANCHORS)), "numbered")
    base = materialize(_packed(rows.select("j", "at", "label", "v"), "j", "at"), "row_blocks")
    query = materialize(_packed(anchors.select("i", "place", "at", "label", "v"), "i", "place"), "anchor_blocks")
    last_i, last_j = query.agg(F.max("i")).first()[0], base.agg(F.max("j")).first()[0]
    found = vectors.sparkSession.createDataFrame([], "i long, a long, pos_at long, pos_score long, at long, score long, rank int")
    for first in range(0, -1 if last_i is None else last_i + 1, panel):
        upto = min(first + panel - 1, last_i)
        a = query.where(F.col("i").between(first, upto)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(last_j).cast("long"))))
        b = base.withColumn("i", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(upto).cast("long"))))
        parts = a.groupBy("i", "j", "k").cogroup(b.groupBy("i", "j", "k")).applyInArrow(_multiply, "i long, j long, k int, width int, tile binary, about array<binary>")
        tiles = materialize(parts.groupBy("i", "j").applyInArrow(_added(positives), _TILES), "tiles")
        order = Window.partitionBy("i", "a").orderBy(F.desc("score"), "at")
        own = tiles.select("i", "a", F.explode("positives").alias("x")).select("i", "a", "x.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
        windows = own.groupBy("i", "a").agg(F.collect_list(F.struct("rank", "at", "score")).alias("windows"))  # at most panel * ANCHORS rows
        met = tiles.select("i", "a", "first", "width", "scores").join(F.broadcast(windows), ["i", "a"])
        met = met.mapInArrow(_within(negatives, low, high), "i long, a long, rank long, pos_at long, pos_score long, at long, score long")
        order = Window.partitionBy("i", "a", "pos_at").orderBy(F.desc("score"), "at")
        kept = met.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        found = found.unionByName(materialize(kept, "negatives"))
        discard(tiles)
    ids = rows.select(F.col("at").alias("__at"), "vec_id")
    names = anchors.select("i", (F.col("place") - F.col("i") * ANCHORS).alias("a"), F.col("vec_id").alias("anchor_id"))
    out = found.join(names, ["i", "a"])
    for at, name in (("pos_at", "positive_id"), ("at", "negative_id")):
        out = out.join(ids, out[at] == F.col("__at")).drop("__at").withColumnRenamed("vec_id", name)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("pos_score").alias("positive_score"), F.col("score").alias("negative_score"))


#: What the registered query asks for.
def anchors_of() -> Column:
    return F.col("vec_id") % 50 == 0


def labels_of() -> Column:
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def oracle(table: str) -> str:
    """DuckDB SQL for the registered query over `table`."""
    return f"""
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM {table}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
