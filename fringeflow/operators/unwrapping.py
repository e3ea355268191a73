"""Phase unwrapping: flood fill within tiles, whole-cycle offsets between the tiles' islands settled over the graph of their seams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, InversionError, MetadataError
from fringeflow.functions.phase import valid, wrapped_phase
from fringeflow.operators import kernels
from fringeflow.operators.cube import numbers
from fringeflow.store import materialize

#: Side of a tile, and how many tiles' sides (then groups of tiles) are joined at once, along each axis.
TILE, FAN = 512, 8
#: Side of a tile whose turns are chosen by cost.
FLOW_TILE = 64
_TWO_PI = 2 * math.pi
_PIXEL = "pair_idx int, row int, col int, w double, q double, turns int, island long"


def unwrap_stack(layers: DataFrame, shape: tuple[int, int], quality: str | None = None, least: float | None = None, tile: int | None = None, method: str = "fill") -> DataFrame:
    """Long rows (row, col, pair_idx, re, im or wrapped, and a quality column) -> row, col, pair_idx, phase.

    A task holds a tile of a layer (and later the seams of FAN x FAN tiles), never a layer. What is
    connected on a layer keeps one multiple of 2 pi: its best pixel (by quality, then row, then
    column; the grid's centre where there is no quality) has its wrapped phase. Where the wrapped
    phases have no residues the result is that of one fill over the whole layer; elsewhere the seams
    between two tiles' islands vote, by quality, for the whole cycles between them, and the strongest votes join first.
    With method "cost" each tile (of FLOW_TILE pixels, unless said) then takes the turns of least cost (see
    kernels.cheapest_turns), which is minimum-cost flow of its residues with quality as costs; the seams are settled as above.
    Pixels that are not valid, or of less than the least quality, have a row with a NULL phase.
    """
    if min(shape) < 1:
        raise DimensionMismatch("the grid is empty")
    if least is not None and quality is None:
        raise InversionError("a least quality needs a quality column")
    if method not in ("fill", "cost"):
        raise MetadataError(f"unknown method {method}")
    tile = tile or (TILE if method == "fill" else FLOW_TILE)
    wrapped = valid(F.col("wrapped")) if "wrapped" in layers.columns else wrapped_phase(F.col("re"), F.col("im"))
    q = valid(F.col(quality)) if quality else F.lit(None).cast("double")
    rows = layers.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("pair_idx").cast("int").alias("pair_idx"), wrapped.alias("w"), q.alias("q"))
    across, down = -(-shape[1] // tile), -(-shape[0] // tile)
    place = F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)
    filled = rows.withColumn("tile", place.cast("long")).groupBy("pair_idx", "tile").applyInArrow(_fill(shape, tile, across, bool(quality), least, method), _PIXEL)
    phase = lambda offset: F.when(F.col("island").isNotNull(), F.col("w") + _TWO_PI * (F.col("turns") + offset)).alias("phase")
    if across * down == 1:
        return filled.select("row", "col", "pair_idx", phase(F.lit(0)))
    filled = materialize(filled, "islands")
    offsets = _offsets(filled, shape, tile, bool(quality))
    return filled.join(offsets, ["pair_idx", "island"], "left").select("row", "col", "pair_idx", phase(F.coalesce("offset", F.lit(0))))


def _fill(shape: tuple[int, int], tile: int, across: int, quality: bool, least: float | None, method: str = "fill"):
    """Of one tile: for each pixel its whole turns over the wrapped phase, and the island it is on."""

    def one(t: pa.Table) -> pa.Table:
        at = t["tile"][0].as_py()
        top, left = at // across * tile, at % across * tile
        size = min(tile, shape[0] - top), min(tile, shape[1] - left)
        r, c = t["row"].to_numpy(), t["col"].to_numpy()
        grid, q = np.full(size, np.nan), None
        grid[r - top, c - left] = t["w"].to_numpy(zero_copy_only=False).astype(float)
        if quality:
            q = np.full(size, np.nan)
            q[r - top, c - left] = t["q"].to_numpy(zero_copy_only=False).astype(float)
        centre = shape[0] // 2 - top, shape[1] // 2 - left
        inside = 0 <= centre[0] < size[0] and 0 <= centre[1] < size[1]
        out, island = kernels.unwrap_islands(grid, q, least, centre if inside else None)
        none = island[r - top, c - left] < 0
        turns = np.round((out - grid) / _TWO_PI)
        if method == "cost":
            price = np.ones(size, np.int64) if q is None else 1 + np.round(1000 * np.clip(np.nan_to_num(q), 0, 1)).astype(np.int64)
            turns = kernels.cheapest_turns(np.where(island >= 0, grid, np.nan), np.nan_to_num(turns), price)
            for k, at_best in enumerate(_best_of(island, q, centre if inside else None)):  # the cost is the same for any number of turns of a whole island
                turns[island == k] -= turns[at_best]
        turns = turns[r - top, c - left]
        ids = at * tile * tile + island[r - top, c - left].astype(np.int64)
        return pa.table({
            "pair_idx": t["pair_idx"], "row": pa.array(r), "col": pa.array(c), "w": t["w"], "q": t["q"],
            "turns": pa.array(np.where(none, 0, np.nan_to_num(turns)).astype(np.int32), mask=none), "island": pa.array(ids, mask=none),
        })

    return one


def _best_of(island: np.ndarray, q: np.ndarray | None, centre: tuple[int, int] | None) -> list[tuple[int, int]]:
    """Of each island its best pixel by quality (or the centre, where it is on it), then row and column."""
    rank = np.zeros(island.shape) if q is None else np.where(np.isfinite(q), q, -np.inf)
    if q is None and centre is not None:
        rank[centre] = 1
    order = np.lexsort((np.arange(island.size), -rank.ravel(), island.ravel()))
    first = np.flatnonzero(np.r_[True, np.diff(island.ravel()[order]) > 0])
    return [tuple(int(x) for x in np.unravel_index(order[f], island.shape)) for f in first if island.ravel()[order[f]] >= 0]


def seams(filled: DataFrame, tile: int, quality: bool) -> DataFrame:
    """pair_idx, a, b, k, w: islands of neighbouring tiles that touch, the cycles that b lies above a, and how strongly the pixels along the seam say so.

    Only pixels at the tiles' edges are joined. Of different numbers of cycles between two islands the one with most quality (or most pixels) counts, then the smaller.
    """
    rows = filled.where("island is not null").select("pair_idx", "row", "col", (F.col("w") + _TWO_PI * F.col("turns")).alias("x"), "island", F.coalesce(F.greatest("q", F.lit(1e-9)), F.lit(1e-9) if quality else F.lit(1.0)).alias("q"))
    found = None
    for axis, dr, dc in (("col", 0, 1), ("row", 1, 0)):
        first = rows.where(F.col(axis) % tile == tile - 1).select("pair_idx", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("x").alias("xa"), F.col("island").alias("a"), F.col("q").alias("qa"))
        both = first.join(rows.where(F.col(axis) % tile == 0), ["pair_idx", "row", "col"])
        d = F.col("x") - F.col("xa")
        k = -F.ceil((d - math.pi) / _TWO_PI)  # what brings the difference to (-pi, pi]
        found_here = both.select("pair_idx", "a", F.col("island").alias("b"), k.cast("long").alias("k"), F.least("qa", "q").alias("w"))
        found = found_here if found is None else found.unionAll(found_here)
    votes = found.groupBy("pair_idx", "a", "b", "k").agg(F.sum("w").alias("w"))
    best = votes.groupBy("pair_idx", "a", "b").agg(F.max(F.struct("w", (-F.abs("k")).alias("near"), "k")).alias("v"))
    return best.select("pair_idx", "a", "b", "v.k", "v.w")


def _tree(group: pa.Table) -> pa.Table:
    """A maximum spanning forest of a group's seams: for each island the one that stands for its tree, and the cycles it lies above it."""
    a, b, k, w = (group[c].to_numpy() for c in ("a", "b", "k", "w"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    top, above = list(range(len(names))), [0] * len(names)

    def find(i: int) -> tuple[int, int]:
        path, total = [], 0
        while top[i] != i:
            path.append(i)
            i = top[i]
        for j in reversed(path):
            total = above[j] = above[j] + (above[top[j]] if top[j] != i else 0)
            top[j] = i
        return i, total

    for e in np.lexsort((b, a, -w)).tolist():
        x, y = int(at[e]), int(at[len(a) + e])
        (rx, ox), (ry, oy) = find(x), find(y)
        if rx == ry:
            continue
        lies = ox + int(k[e]) - oy  # ry above rx
        if names[rx] < names[ry]:
            top[ry], above[ry] = rx, lies
        else:
            top[rx], above[rx] = ry, -lies
    got = [find(i) for i in range(len(names))]
    n = len(names)
    return pa.table({"pair_idx": pa.array([group["pair_idx"][0].as_py()] * n, pa.int32()), "node": names, "head": names[[r for r, _ in got]], "above": pa.array([o for _, o in got], pa.int64())})


def _offsets(filled: DataFrame, shape: tuple[int, int], tile: int, quality: bool) -> DataFrame:
    """pair_idx, island, offset (cycles to add) of every island.

    Seams are settled within FAN x FAN tiles, then within FAN x FAN of such groups, and so on: a group
    holds the seams that its parts have with each other, and islands that were joined before count as one.
    """
    across = -(-shape[1] // tile)
    edges = materialize(seams(filled, tile, quality), "seams")
    where = lambda i, span: (F.floor(F.floor(F.col(i) / (tile * tile)) / across / span), F.floor(F.floor(F.col(i) / (tile * tile)) % across / span))
    heads, span = None, 1
    while span < max(across, -(-shape[0] // tile)):
        below, span = span, span * FAN
        (ar, ac), (br, bc), (lar, lac), (lbr, lbc) = (where(i, n) for n in (span, below) for i in ("a", "b"))
        e = edges.where((ar == br) & (ac == bc) & ((lar != lbr) | (lac != lbc))).withColumns({"gr": ar, "gc": ac})
        if heads is not None:
            for i, sign in (("a", 1), ("b", -1)):
                mine = heads.select("pair_idx", F.col("node").alias(i), F.col("head").alias("h"), F.col("above").alias("o"))
                e = e.join(mine, ["pair_idx", i], "left").withColumns({"k": F.col("k") + sign * F.coalesce("o", F.lit(0)), i: F.coalesce("h", F.col(i))}).drop("h", "o")
        new = e.select("pair_idx", "gr", "gc", "a", "b", "k", "w").groupBy("pair_idx", "gr", "gc").applyInArrow(_tree, "pair_idx int, node long, head long, above long")
        if heads is None:
            heads = materialize(new, "heads")
            continue
        new = materialize(new, "heads")
        step = new.select("pair_idx", F.col("node").alias("head"), F.col("head").alias("h"), F.col("above").alias("o"))
        moved = heads.join(step, ["pair_idx", "head"], "left").select("pair_idx", "node", F.coalesce("h", "head").alias("head"), (F.col("above") + F.coalesce("o", F.lit(0))).alias("above"))
        fresh = new.join(heads.select("pair_idx", "node"), ["pair_idx", "node"], "left_anti")
        heads = materialize(moved.unionByName(fresh), "heads")
    # the pixel of each tree that keeps its wrapped phase
    first = [F.col("q").alias("q") if quality else ((F.col("row") == shape[0] // 2) & (F.col("col") == shape[1] // 2)).cast("double").alias("q"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"), "turns"]
    best = filled.where("island is not null").groupBy("pair_idx", "island").agg(F.max(F.struct(*first)).alias("s"))
    own = best.join(heads.withColumnRenamed("node", "island"), ["pair_idx", "island"], "left")
    own = own.select("pair_idx", "island", F.coalesce("head", "island").alias("head"), F.coalesce("above", F.lit(0)).alias("above"), "s")
    seeds = own.groupBy("pair_idx", "head").agg(F.max(F.struct("s.q", "s.r", "s.c", (F.col("s.turns") + F.col("above")).alias("t"))).alias("m"))
    return own.join(seeds, ["pair_idx", "head"]).select("pair_idx", "island", (F.col("above") - F.col("m.t")).alias("offset"))


def zero_filled(layers: DataFrame) -> DataFrame:
    """For an outside unwrapper: NoData as 0 phase and 0 coherence, and `was_valid` to restore it by."""
    return layers.withColumn("was_valid", valid(F.col("wrapped")).isNotNull()).withColumn("wrapped", F.coalesce(valid(F.col("wrapped")), F.lit(0.0))).withColumn("coh", F.when(F.col("was_valid"), F.coalesce(valid(F.col("coh")), F.lit(0.0))).otherwise(F.lit(0.0)))


def restored(unwrapped: DataFrame) -> DataFrame:
    return unwrapped.withColumn("phase", F.when(F.col("was_valid"), F.col("phase"))).drop("was_valid")
