"""ISCE interferogram folders: one subfolder a pair, raw bands described by GDAL VRT files."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, replace
from datetime import date, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, MetadataError, RasterError, StackIOError, UnsupportedFormat
from fringeflow.functions.phase import WAVELENGTH_M
from fringeflow.operators.cube import Meta, Pair, Stack, to_pixels
from fringeflow.sources import raster
from fringeflow.sources.files import exists, listed, pixels_of, same_file, store_uri, whole_uri

_PAIR = re.compile(r"(\d{8})_(\d{8})")
# GDAL's names of sample types.
_TYPES = {"Float32": "f4", "Float64": "f8", "CFloat32": "c8", "Byte": "u1"}


@dataclass(frozen=True)
class IsceConfig:
    unwrapped: str = "filt_fine.unw"
    coherence: str = "filt_fine.cor"
    wrapped: str = "filt_fine.int"
    components: str = "filt_fine.unw.conncomp"
    baselines: str | None = None
    wavelength_m: float = WAVELENGTH_M
    incidence_deg: float = 39.0
    mask_zero_amplitude: bool = True


@dataclass(frozen=True)
class Band:
    source: str
    kind: str  # numpy type with byte order
    offset: int
    pixel: int
    line: int


@dataclass(frozen=True)
class Layout:
    rows: int
    cols: int
    bands: tuple[Band, ...]


def parse_vrt(text: str, path: str = "") -> Layout:
    """Raw bands in order of their `band` attribute, which must be 1..n."""
    try:
        root = ET.fromstring(text)
        cols, rows = int(root.attrib["rasterXSize"]), int(root.attrib["rasterYSize"])
        bands = {}
        for b in root.findall("VRTRasterBand"):
            if b.attrib.get("subClass") != "VRTRawRasterBand":
                raise UnsupportedFormat(f"{path}: only raw bands are read")
            kind = _TYPES.get(b.attrib.get("dataType", ""))
            if kind is None:
                raise UnsupportedFormat(f"{path}: samples of type {b.attrib.get('dataType')}")
            order = {"LSB": "<", "MSB": ">"}[b.findtext("ByteOrder", "LSB").strip()]
            size = np.dtype(kind).itemsize
            bands[int(b.attrib["band"])] = Band(b.findtext("SourceFilename").strip(), order + kind, int(b.findtext("ImageOffset", "0")), int(b.findtext("PixelOffset", str(size))), int(b.findtext("LineOffset", str(size * cols))))
    except (ET.ParseError, KeyError, ValueError, AttributeError) as e:
        raise MetadataError(f"{path}: {e!r}") from e
    if rows < 1 or cols < 1 or sorted(bands) != list(range(1, len(bands) + 1)) or not bands:
        raise MetadataError(f"{path}: bands must be numbered from 1 without gaps")
    return Layout(rows, cols, tuple(bands[k] for k in sorted(bands)))


def read_band(data: bytes, layout: Layout, band: int, path: str = "", kinds: tuple[str, ...] = ("f4", "f8")) -> np.ndarray:
    """One band (from 1) of a raw file; its size is checked before anything is allocated."""
    if not 1 <= band <= len(layout.bands):
        raise MetadataError(f"{path}: there is no band {band}")
    b = layout.bands[band - 1]
    if b.kind[1:] not in kinds:
        raise UnsupportedFormat(f"{path}: band {band} has samples of type {b.kind}")
    size = np.dtype(b.kind).itemsize
    end = b.offset + (layout.rows - 1) * b.line + (layout.cols - 1) * b.pixel + size
    if min(b.offset, b.line, b.pixel) < 0 or end > len(data):
        raise RasterError(f"{path}: {len(data)} bytes are fewer than the {end} that its description needs")
    return np.ndarray((layout.rows, layout.cols), b.kind, data, b.offset, (b.line, b.pixel)).copy()


def pair_folders(spark: SparkSession, folder: str) -> list[tuple[date, date, str]]:
    """Subfolders named YYYYMMDD_YYYYMMDD, by date."""
    out = []
    for name in listed(spark, folder, folders=True):
        m = _PAIR.fullmatch(name)
        if not m:
            continue
        try:
            a, b = (datetime.strptime(x, "%Y%m%d").date() for x in m.groups())
        except ValueError:
            continue
        if a >= b:
            raise MetadataError(f"{name}: the reference must be the earlier date")
        out.append((a, b, name))
    if not out:
        raise MetadataError(f"{folder}: no subfolder named YYYYMMDD_YYYYMMDD")
    return sorted(out)


def read_baselines(spark: SparkSession, folder: str, names: list[str]) -> dict[str, float]:
    """Mean of the `Bperp (average):` lines of each pair's files; a pair without any is left out, none at all is an error."""
    if not exists(spark, folder):
        raise StackIOError(f"{folder}: no such folder")
    have = [n for n in names if exists(spark, f"{folder}/{n}")]
    if not have:
        raise MetadataError(f"{folder}: no baselines for any pair")
    lines = spark.read.text([f"{folder}/{n}" for n in have]).select("value", F.col("_metadata.file_path").alias("path"))
    got = lines.select(F.regexp_extract("path", r"(\d{8}_\d{8})/[^/]*$", 1).alias("pair"), F.regexp_extract("value", r"^\s*Bperp \(average\):\s*([-+0-9.eE]+)\s*$", 1).alias("x"))
    got = got.where("x <> ''").groupBy("pair").agg(F.avg(F.expr("try_cast(x AS DOUBLE)")).alias("b")).where("b is not null")
    out = {r["pair"]: r["b"] for r in got.collect()}
    if not out:
        raise MetadataError(f"{folder}: no baselines for any pair")
    return out


def dimensions(spark: SparkSession, folder: str, config: IsceConfig) -> tuple[tuple[date, ...], tuple[Pair, ...], list[str]]:
    """Epochs (all dates of pairs), pairs and their folders."""
    found = pair_folders(spark, folder)
    epochs = tuple(sorted({d for a, b, _ in found for d in (a, b)}))
    at = {d: i for i, d in enumerate(epochs)}
    base = read_baselines(spark, config.baselines, [n for _, _, n in found]) if config.baselines else {}
    return epochs, tuple(Pair(at[a], at[b], base.get(n, 0.0)) for a, b, n in found), [n for _, _, n in found]


def descriptions(spark: SparkSession, paths: list[str]) -> list[Layout]:
    """The VRT beside each path, all read by one job; what they say of their bands' files becomes whole paths."""
    vrts = [f"{p}.vrt" for p in paths]
    for p in vrts:
        if not exists(spark, p):
            raise StackIOError(f"{p}: no such file")
    texts = spark.read.text(vrts, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()  # a row a file
    at = {same_file(r.path): r.value for r in texts}
    return [_placed(parse_vrt(at[same_file(whole_uri(spark, v))], v), v) for v in vrts]


def _placed(layout: Layout, vrt: str) -> Layout:
    folder = vrt.rpartition("/")[0]
    return replace(layout, bands=tuple(b if "://" in b.source or b.source.startswith("/") else replace(b, source=f"{folder}/{b.source}") for b in layout.bands))


def _bands(spark: SparkSession, layouts: list[Layout], bands: tuple[int, ...], values: list[str], index: str, kinds: tuple[str, ...] = ("f4", "f8")) -> DataFrame:
    """row, col, index, values: some bands (from 1) of each layer, each from its own file; a complex band gives two values.

    Tasks read blocks of rows; where they have no client for the store, a whole file each.
    """
    for x in layouts:
        for k in bands:
            if not 1 <= k <= len(x.bands):
                raise MetadataError(f"there is no band {k}")
            if x.bands[k - 1].kind[1:] not in kinds:
                raise UnsupportedFormat(f"{x.bands[k - 1].source}: band {k} has samples of type {x.bands[k - 1].kind}")
    uris = {b.source: store_uri(spark, b.source) for x in layouts for b in x.bands}
    if None not in uris.values():
        layers = [raster.raw((x.rows, x.cols), [{"uri": uris[b.source], "type": b.kind, "offset": b.offset, "pixel": b.pixel, "line": b.line} for b in (x.bands[k - 1] for k in bands)]) for x in layouts]
        return raster.scan(spark, layers, values, index)
    at, parts = 0, None
    for k in bands:
        width = 2 if kinds == ("c8",) else 1
        rows = pixels_of(spark, [x.bands[k - 1].source for x in layouts], _whole(layouts, k), values[at : at + width], index)
        parts = rows if parts is None else parts.join(rows, ["row", "col", index])
        at += width
    return parts


def _whole(layouts: list[Layout], k: int):
    by_source = {x.bands[k - 1].source: x for x in layouts}

    def decode(path: str, data: bytes) -> list[np.ndarray]:
        grid = read_band(data, by_source[path], k, path, (by_source[path].bands[k - 1].kind[1:],))
        return [grid.real.astype(float), grid.imag.astype(float)] if grid.dtype.kind == "c" else [grid.astype(float)]

    return decode


def _layers(spark: SparkSession, folder: str, names: list[str], file: str) -> tuple[list[Layout], tuple[int, int]]:
    """What the descriptions of a file in each pair's folder say, and its shape."""
    layouts = descriptions(spark, [f"{folder}/{n}/{file}" for n in names])
    shapes = {(x.rows, x.cols) for x in layouts}
    if len(shapes) != 1:
        raise DimensionMismatch(f"{file}: pairs of different sizes: {sorted(shapes)}")
    return layouts, shapes.pop()


def read_unwrapped(spark: SparkSession, folder: str, config: IsceConfig | None = None, coherence: bool = True) -> Stack:
    """The unwrapped stack, with coherence where every pair has it; pixels are radar coordinates."""
    config = config or IsceConfig()
    epochs, pairs, names = dimensions(spark, folder, config)
    layouts, shape = _layers(spark, folder, names, config.unwrapped)
    if any(len(x.bands) < 2 for x in layouts):
        raise MetadataError(f"{config.unwrapped}: the phase is in band 2, and there is only one")
    rows = _bands(spark, layouts, (1, 2), ["seen", "phase"], "pair_idx")
    if config.mask_zero_amplitude:
        rows = rows.withColumn("phase", F.when(F.coalesce(F.col("seen") != 0, F.lit(True)), F.col("phase")))
    rows = rows.withColumn("seen", F.coalesce(F.col("seen") != 0, F.lit(True)).cast("double"))
    values = {"phase": "phase"}
    if coherence and all(exists(spark, f"{folder}/{n}/{config.coherence}.vrt") for n in names):
        layouts, other = _layers(spark, folder, names, config.coherence)
        widths = {len(x.bands) for x in layouts}
        if max(widths) > 2:
            raise MetadataError(f"{config.coherence}: coherence has one band or two, not {max(widths)}")
        # coherence is the last band, whichever number that has
        coh = _bands(spark, [replace(x, bands=x.bands[-1:]) for x in layouts], (1,), ["coh"], "pair_idx")
        if other != shape:
            raise DimensionMismatch(f"coherence {other} is not of the size of the phase {shape}")
        # one grouping by pixel takes both; a pair's coherence counts only where its amplitude is not zero
        rows = rows.withColumn("coh", F.lit(None).cast("double")).unionByName(coh.withColumn("phase", F.lit(None).cast("double")).withColumn("seen", F.lit(None).cast("double")))
        values |= {"coh": "coh", "seen": "seen"}
    px = to_pixels(rows, "pair_idx", len(pairs), **values)
    if "coh" in values:
        px = px.withColumn("coh", F.zip_with("coh", "seen", lambda c, s: F.when(s != 0, c))).drop("seen") if config.mask_zero_amplitude else px.drop("seen")
    return Stack(px, epochs, pairs, shape, Meta(wavelength_m=config.wavelength_m, incidence_deg=config.incidence_deg))


def read_wrapped(spark: SparkSession, folder: str, config: IsceConfig | None = None) -> tuple[DataFrame, tuple[date, ...], tuple[Pair, ...], tuple[int, int]]:
    """Long rows (row, col, pair_idx, re, im); exact zeros are NoData."""
    config = config or IsceConfig()
    epochs, pairs, names = dimensions(spark, folder, config)
    layouts, shape = _layers(spark, folder, names, config.wrapped)
    rows = _bands(spark, layouts, (1,), ["re", "im"], "pair_idx", ("c8",))
    seen = ~((F.col("re") == 0) & (F.col("im") == 0))
    return rows.select("row", "col", "pair_idx", F.when(seen, F.col("re")).alias("re"), F.when(seen, F.col("im")).alias("im")), epochs, pairs, shape


def read_components(spark: SparkSession, folder: str, config: IsceConfig | None = None) -> DataFrame:
    """row, col, pair_idx, component (0: not unwrapped)."""
    config = config or IsceConfig()
    _, _, names = dimensions(spark, folder, config)
    layouts, _ = _layers(spark, folder, names, config.components)
    rows = _bands(spark, layouts, (1,), ["component"], "pair_idx", ("u1",))
    return rows.withColumn("component", F.col("component").cast("smallint"))


def read_los(spark: SparkSession, path: str) -> DataFrame:
    """row, col, incidence_deg, azimuth_deg; exact (0, 0) is NoData."""
    rows = _bands(spark, descriptions(spark, [path]), (1, 2), ["incidence_deg", "azimuth_deg"], "layer").drop("layer")
    none = (F.col("incidence_deg") == 0) & (F.col("azimuth_deg") == 0)
    return rows.select("row", "col", F.when(~none, F.col("incidence_deg")).alias("incidence_deg"), F.when(~none, F.col("azimuth_deg")).alias("azimuth_deg"))
