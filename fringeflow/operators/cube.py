"""Cubes as DataFrames: a long row for each layer of a pixel, or one row a pixel with an array over the layers."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, InvalidNetwork, MetadataError
from fringeflow.functions.phase import WAVELENGTH_M, valid


@dataclass(frozen=True)
class Pair:
    ref: int
    sec: int
    perp_baseline_m: float = 0.0


@dataclass(frozen=True)
class Meta:
    transform: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    crs: str | None = None
    wavelength_m: float = WAVELENGTH_M
    incidence_deg: float = 39.0
    heading_deg: float | None = None
    los_vector: tuple[float, float, float] | None = None


@dataclass(frozen=True)
class Stack:
    """px: row, col, phase ARRAY<DOUBLE> over the pairs (and coh, likewise, if known)."""

    px: DataFrame
    epochs: tuple[date, ...]
    pairs: tuple[Pair, ...]
    shape: tuple[int, int]
    meta: Meta = field(default_factory=Meta)

    def with_px(self, px: DataFrame) -> Stack:
        return replace(self, px=px)


@dataclass(frozen=True)
class Series:
    """px: row, col, disp ARRAY<DOUBLE> over the epochs, metres since the first."""

    px: DataFrame
    epochs: tuple[date, ...]
    shape: tuple[int, int]
    meta: Meta = field(default_factory=Meta)

    def with_px(self, px: DataFrame) -> Series:
        return replace(self, px=px)


def years(epochs: tuple[date, ...]) -> np.ndarray:
    return np.array([(e - epochs[0]).days / 365.25 for e in epochs])


def every(first: date, days: int, n: int) -> tuple[date, ...]:
    return tuple(first + timedelta(days=days * i) for i in range(n))


def check_epochs(epochs) -> None:
    if not epochs:
        raise InvalidNetwork("no epochs")
    if any(a >= b for a, b in zip(epochs, epochs[1:], strict=False)):
        raise InvalidNetwork("epochs must be strictly increasing")


def check_pairs(pairs, n_epochs: int, n_layers: int | None = None) -> None:
    if n_layers is not None and n_layers != len(pairs):
        raise DimensionMismatch(f"{n_layers} layers for {len(pairs)} pairs")
    seen = set()
    for p in pairs:
        if not (0 <= p.ref < n_epochs and 0 <= p.sec < n_epochs):
            raise InvalidNetwork(f"pair {p.ref}-{p.sec} is outside the {n_epochs} epochs")
        if p.ref >= p.sec:
            raise InvalidNetwork(f"pair {p.ref}-{p.sec}: the reference must be the earlier epoch")
        if (p.ref, p.sec) in seen:
            raise InvalidNetwork(f"pair {p.ref}-{p.sec} occurs twice")
        seen.add((p.ref, p.sec))


def check_meta(meta: Meta) -> None:
    if not (np.isfinite(meta.wavelength_m) and meta.wavelength_m > 0):
        raise MetadataError("wavelength must be finite and positive")


def to_pixels(long: DataFrame, index: str, n: int, **values: str) -> DataFrame:
    """Long rows -> one row a pixel; values: new array column = old column. Absent layers and numbers that are not finite become NULL.

    Of rows that repeat a layer one is taken. One shuffle, by pixel.
    """
    kept = {a: valid(F.col(c)) for a, c in values.items()}
    rows = long.where(F.col(index).between(0, n - 1)).select("row", "col", F.col(index).cast("int").alias("__i"), *(c.alias(a) for a, c in kept.items()))
    # first by layer: repeated layers would break the map; the second grouping needs no shuffle of its own
    rows = rows.repartition("row", "col").groupBy("row", "col", "__i").agg(*(F.first(a, ignorenulls=True).alias(a) for a in kept))
    rows = rows.groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("__i", F.struct(*kept)))).alias("__m"))
    layers = F.sequence(F.lit(0), F.lit(n - 1))

    def array(a: str):
        return F.transform(layers, lambda i: F.try_element_at(F.col("__m"), i).getField(a)).alias(a)

    return rows.select("row", "col", *map(array, kept))


def to_long(px: DataFrame, index: str, value: str, column: str) -> DataFrame:
    """One row a pixel -> row, col, index, value."""
    return px.select("row", "col", F.posexplode(column).alias(index, value))


def as_stored(column: pa.Array, n: int) -> np.ndarray:
    """Arrow lists of n numbers as a matrix, NULL as NaN and all else as it is; without a copy where nothing is NULL."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pa.array([x if x is not None else [None] * n for x in column.to_pylist()], pa.list_(pa.float64()))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(x) != len(column) * n:
        raise DimensionMismatch(f"arrays must have {n} layers")
    return x.reshape(-1, n)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """Arrow lists of n numbers as a matrix; NULL and anything not finite as NaN."""
    x = as_stored(column, n)
    return np.where(np.isfinite(x), x, np.nan)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as Arrow lists, NaN as NULL."""
    flat = pa.array(np.ascontiguousarray(x, float).ravel(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)


def numbers(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, float), from_pandas=True)


def map_pixels(px: DataFrame, columns: list[str], kernel, out: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """px with the columns that kernel makes of some of its own, batch by batch in Arrow.

    kernel takes a pa.Array for each of `columns` and returns one for each of `out` (name: type);
    the columns in `keep` (all but the replaced ones, unless said) go through as they are.
    """
    keep = [c for c in px.columns if c not in out] if keep is None else keep
    names = [*keep, *out]

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = kernel(*(b.column(c) for c in columns))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names)

    needed = list(dict.fromkeys([*keep, *columns]))
    schema = ", ".join([*(f"`{c}` {px.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` {t}" for c, t in out.items())])
    return px.select(*needed).mapInArrow(run, schema)
