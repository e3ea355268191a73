"""Stacks described by a `stack.json` beside GeoTIFF files, and series written as a file an epoch."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, MetadataError
from fringeflow.operators.cube import Meta, Pair, Series, Stack, check_meta, check_pairs, to_long, to_pixels
from fringeflow.sources import geotiff, raster
from fringeflow.sources.files import listed, store_uri, text_of


@dataclass(frozen=True)
class Manifest:
    folder: str
    meta: Meta
    epochs: tuple[date, ...]
    pairs: tuple[Pair, ...] | None = None
    files: tuple[str, ...] = field(default=())
    amplitudes: tuple[str, ...] | None = None
    coherence: tuple[str, ...] | None = None


def load(spark: SparkSession, folder: str) -> Manifest:
    """stack.json, checked: wavelength, dates, and lists that go with each other."""
    path = f"{folder}/stack.json"
    try:
        got = json.loads(text_of(spark, path))
        epochs = tuple(date.fromisoformat(e) for e in got["epochs"])
        meta = Meta(wavelength_m=float(got["wavelength_m"]), incidence_deg=float(got["incidence_deg"]), heading_deg=got.get("heading_deg"))
        ifgs = got.get("ifgs")
        pairs = None if ifgs is None else tuple(Pair(int(i["reference"]), int(i["secondary"]), float(i["perp_baseline_m"])) for i in ifgs)
        files = tuple(i["file"] for i in ifgs or ())
    except (ValueError, KeyError, TypeError) as e:
        raise MetadataError(f"{path}: {e!r}") from e
    check_meta(meta)
    if not epochs:
        raise MetadataError(f"{path}: no epochs")
    if any(a >= b for a, b in zip(epochs, epochs[1:], strict=False)):
        raise MetadataError(f"{path}: epochs must be strictly increasing")
    lists = {k: None if got.get(k) is None else tuple(got[k]) for k in ("amplitudes", "coherence")}
    return Manifest(folder, meta, epochs, pairs, files, **lists)


def _georeferenced(spark: SparkSession, m: Manifest, paths: list[str]) -> tuple[tuple[int, int], Meta]:
    found = geotiff.headers(spark, paths)
    return geotiff.same_shape(found), replace(m.meta, transform=found[0][1].transform, crs=found[0][1].crs)


def part_path(file: str, part: str) -> str:
    """x.tif -> x_re.tif or x_im.tif."""
    return f"{file.removesuffix('.tif')}_{part}.tif"


def read_interferograms(spark: SparkSession, folder: str) -> tuple[DataFrame, Manifest, tuple[int, int]]:
    """Long rows (row, col, pair_idx, re, im), the manifest with its georeference, and the grid's shape."""
    m = load(spark, folder)
    if not m.pairs:
        raise MetadataError(f"{folder}/stack.json: no ifgs")
    check_pairs(m.pairs, len(m.epochs), len(m.files))
    re, im = ([f"{folder}/{part_path(f, p)}" for f in m.files] for p in ("re", "im"))
    shape, meta = _georeferenced(spark, m, re + im)
    parts = geotiff.read(spark, re + im, "v")
    n = len(re)
    # both parts of a pair carry its number: one grouping puts them in a row, where a join would move them twice
    rows = parts.groupBy("row", "col", (F.col("layer") % n).alias("pair_idx")).agg(F.max(F.when(F.col("layer") < n, F.col("v"))).alias("re"), F.max(F.when(F.col("layer") >= n, F.col("v"))).alias("im"))
    return rows, replace(m, meta=meta), shape


def read_amplitudes(spark: SparkSession, folder: str) -> tuple[DataFrame, Manifest, tuple[int, int]]:
    m = load(spark, folder)
    if not m.amplitudes:
        raise MetadataError(f"{folder}/stack.json: no amplitudes")
    if len(m.amplitudes) != len(m.epochs):
        raise DimensionMismatch(f"{len(m.amplitudes)} amplitudes for {len(m.epochs)} epochs")
    paths = [f"{folder}/{f}" for f in m.amplitudes]
    shape, meta = _georeferenced(spark, m, paths)
    return geotiff.read(spark, paths, "amplitude", "epoch_idx"), replace(m, meta=meta), shape


def read_coherence(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple[int, int]] | None:
    """Long rows (row, col, pair_idx, coh) and their shape; None if the manifest has no coherence."""
    m = load(spark, folder)
    if m.coherence is None:
        return None
    if not m.coherence:
        raise MetadataError(f"{folder}/stack.json: coherence is empty")
    if len(m.coherence) != len(m.pairs or ()):
        raise DimensionMismatch(f"{len(m.coherence)} coherence maps for {len(m.pairs or ())} pairs")
    paths = [f"{folder}/{f}" for f in m.coherence]
    return geotiff.read(spark, paths, "coh", "pair_idx"), _georeferenced(spark, m, paths)[0]


def read_map(spark: SparkSession, path: str, meta: Meta, value: str = "velocity") -> tuple[DataFrame, Meta, tuple[int, int]]:
    """A map and its georeference; what a GeoTIFF does not say comes from `meta`."""
    (shape, own), = geotiff.headers(spark, [path])
    return geotiff.read(spark, [path], value).drop("layer"), replace(meta, transform=own.transform, crs=own.crs), shape


def read_series(spark: SparkSession, folder: str, meta: Meta) -> Series:
    """disp_YYYYMMDD.tif files in order of their dates; other names are ignored."""
    found = []
    for name in listed(spark, folder):
        if name.startswith("disp_") and name.endswith(".tif"):
            try:
                found.append((datetime.strptime(name[5:-4], "%Y%m%d").date(), name))
            except ValueError:
                continue
    if not found:
        raise MetadataError(f"{folder}: no disp_YYYYMMDD.tif")
    found.sort()
    paths = [f"{folder}/{n}" for _, n in found]
    heads = geotiff.headers(spark, paths)
    shape = geotiff.same_shape(heads)
    px = to_pixels(geotiff.read(spark, paths, "v", "epoch_idx"), "epoch_idx", len(paths), disp="v")
    return Series(px, tuple(d for d, _ in found), shape, replace(meta, transform=heads[0][1].transform, crs=heads[0][1].crs))


def write_series(series: Series, folder: str) -> list[str]:
    days = F.array(*[F.lit(f"disp_{e:%Y%m%d}") for e in series.epochs])
    rows = to_long(series.px, "e", "v", "disp").withColumn("name", F.element_at(days, F.col("e") + 1))
    return geotiff.write_layers(rows, "name", "v", series.shape, series.meta, folder)


def write_stack_json(spark: SparkSession, folder: str, stack: Stack, **lists: list[str]) -> None:
    from fringeflow.sources.files import write_bytes

    got = {"wavelength_m": stack.meta.wavelength_m, "incidence_deg": stack.meta.incidence_deg, "epochs": [e.isoformat() for e in stack.epochs]}
    if stack.meta.heading_deg is not None:
        got["heading_deg"] = stack.meta.heading_deg
    got["ifgs"] = [{"reference": p.ref, "secondary": p.sec, "perp_baseline_m": p.perp_baseline_m, "file": f"ifg_{k}.tif"} for k, p in enumerate(stack.pairs)]
    write_bytes(spark, f"{folder}/stack.json", json.dumps(got | lists).encode())


def read_raw_cube(spark: SparkSession, folder: str) -> Stack:
    """`meta.json` with `phase.f32` and, where they are, `coherence.f32` and `dem.f32`: little-endian floats, pairs by rows by columns.

    Heights are a column height_m; `los_vector` (east, north, up) goes to the metadata. A task reads a block of rows of a layer; where
    tasks have no client for the store, one layer (a fixed-length record of the file).
    """
    import numpy as np
    import pyarrow as pa

    got = json.loads(text_of(spark, f"{folder}/meta.json"))
    rows, cols, n = got["rows"], got["cols"], got["n_pairs"]
    epochs = tuple(date.fromisoformat(str(e)[:10]) if "-" in str(e) else datetime.strptime(str(e), "%Y%m%d").date() for e in got["epochs"])
    pairs = tuple(Pair(int(p[0]), int(p[1]), float(p[2]) if len(p) > 2 else 0.0) if isinstance(p, list) else Pair(int(p["ref"]), int(p["sec"]), float(p.get("bperp", 0.0))) for p in got["pairs"])
    if len(pairs) != n:
        raise DimensionMismatch(f"{n} layers for {len(pairs)} pairs")
    check_pairs(pairs, len(epochs))
    size = rows * cols * 4

    def layers(name: str, value: str) -> DataFrame:
        if uri := store_uri(spark, f"{folder}/{name}"):
            many = 1 if name == "dem.f32" else n
            return raster.scan(spark, [raster.raw((rows, cols), [{"uri": uri, "type": "<f4", "offset": k * size, "pixel": 4, "line": 4 * cols}]) for k in range(many)], [value], "pair_idx")
        records = spark.sparkContext.binaryRecords(f"{folder}/{name}", size).zipWithIndex()  # the one reader Spark has for records of fixed length
        table = records.map(lambda x: (bytes(x[0]), x[1])).toDF("content binary, pair_idx long")

        def run(batches):
            for b in batches:
                for content, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    v = np.frombuffer(content, "<f4").astype(float)
                    r, c = np.divmod(np.arange(rows * cols), cols)
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(np.full(len(v), k), pa.int32()), pa.array(v, from_pandas=True)], ["row", "col", "pair_idx", value])

        return table.mapInArrow(run, f"row int, col int, pair_idx int, {value} double")

    long = layers("phase.f32", "phase").withColumn("coh", F.lit(None).cast("double"))
    have = listed(spark, folder)
    coh = layers("coherence.f32", "coh").withColumn("phase", F.lit(None).cast("double")) if "coherence.f32" in have else None
    if coh is not None:
        long = long.unionByName(coh)
    px = to_pixels(long, "pair_idx", n, phase="phase", coh="coh")
    if "dem.f32" in have:
        px = px.join(layers("dem.f32", "height_m").select("row", "col", "height_m"), ["row", "col"], "left")
    geo, los = got.get("geo") or {}, got.get("los_vector")
    if los is not None and len(los) != 3:
        raise MetadataError(f"{folder}/meta.json: los_vector has three numbers")
    transform = tuple(geo["transform"]) if len(geo.get("transform", ())) == 4 else (0.0, 0.0, 1.0, 1.0)
    return Stack(px, epochs, pairs, (rows, cols), Meta(transform, geo.get("crs"), float(got["wavelength_m"]), float(got["incidence_deg"]), los_vector=los and tuple(map(float, los))))


