"""Rasters as a Spark data source: a partition for each block of rows, or of tiles, so that no task reads or writes a whole file.

`fringeflow-raster` reads layers that are described by their headers alone. Filters on row, column and
layer are pushed down to blocks: others are not opened. `fringeflow-geotiff` writes tiles that tasks
place at fixed offsets of a file under a temporary name; the commit writes the header and gives the
file its name, an abort leaves nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from fringeflow.errors import MetadataError, RasterError, StackIOError
from fringeflow.operators.cube import Meta, numbers
from fringeflow.sources import geotiff
from fringeflow.sources.files import opened, store_uri

#: Pixels of a partition, and of a batch within it.
BLOCK, BATCH = 1 << 21, 1 << 18
#: Side of the tiles that are written, and files that a writing task keeps open.
TILE, OPEN = 256, 64


@dataclass(frozen=True)
class Block(InputPartition):
    layer: int
    r0: int
    r1: int
    c0: int
    c1: int


class RasterSource(DataSource):
    """Options: `layers` (JSON, see scan()), `values` (JSON names of the value columns), `index` (name of the layer's number), `block` (pixels)."""

    @classmethod
    def name(cls) -> str:
        return "fringeflow-raster"

    def schema(self) -> str:
        return ", ".join(["row int", "col int", f"`{self.options.get('index', 'layer')}` int", *(f"`{v}` double" for v in json.loads(self.options["values"]))])

    def reader(self, schema) -> RasterReader:
        return RasterReader(json.loads(self.options["layers"]), schema.fieldNames(), int(self.options.get("block", BLOCK)))


class RasterReader(DataSourceReader):
    def __init__(self, layers: list[dict], names: list[str], block: int):
        self.layers, self.names, self.block = layers, names, block
        self.bounds = {names[k]: [0, (1 << 31) - 1] for k in range(3)}
        self.only: set[int] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Bounds on row, column and layer choose blocks; Spark applies the filters to the rows all the same."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.bounds:
                low, high = self.bounds[name]
                if isinstance(f, In) and name == self.names[2]:
                    self.only = set(f.value) if self.only is None else self.only & set(f.value)
                elif isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = min(high, f.value - isinstance(f, LessThan))
                self.bounds[name] = [low, high]
            yield f

    def partitions(self) -> list[Block]:
        (r_low, r_high), (c_low, c_high), (l_low, l_high) = (self.bounds[n] for n in self.names[:3])
        out = []
        for k, x in enumerate(self.layers):
            if not l_low <= k <= l_high or (self.only is not None and k not in self.only):
                continue
            (rows, cols), (down, across) = x["shape"], x["step"]
            wide = cols if down * cols <= self.block or across >= cols else max(across, self.block // down // across * across)
            high = max(down, self.block // min(wide, cols) // down * down)
            for r in range(r_low // high * high, min(rows, r_high + 1), high):
                for c in range(c_low // wide * wide, min(cols, c_high + 1), wide):
                    out.append(Block(k, max(r, r_low), min(r + high, rows, r_high + 1), max(c, c_low), min(c + wide, cols, c_high + 1)))
        return out or [Block(-1, 0, 0, 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        b = partition
        if b.layer < 0:
            return
        x = self.layers[b.layer]
        read = reader_of(x)
        n = b.c1 - b.c0
        step = max(1, BATCH // max(1, n), x["step"][0])
        for r0 in range(b.r0, b.r1, step):
            r1 = min(b.r1, r0 + step)
            grids = read(r0, r1, b.c0, b.c1)
            if len(grids) != len(self.names) - 3:
                raise MetadataError(f"layer {b.layer} has {len(grids)} values, not {len(self.names) - 3}")
            for s in range(r0, r1, max(1, BATCH // max(1, n))):
                e = min(r1, s + max(1, BATCH // max(1, n)))
                place = [pa.array(np.repeat(np.arange(s, e), n), pa.int32()), pa.array(np.tile(np.arange(b.c0, b.c1), e - s), pa.int32()), pa.array(np.full((e - s) * n, b.layer), pa.int32())]
                values = (g[s - r0 : e - r0].astype(float).ravel() for g in grids)
                yield pa.RecordBatch.from_arrays([*place, *(numbers(np.where(np.isfinite(v), v, np.nan)) for v in values)], self.names)


def reader_of(x: dict):
    """read(r0, r1, c0, c1) of a described layer: its values' grids."""
    if x["kind"] == "hdf5":
        from fringeflow.sources.hdf5 import dataset_reader

        return dataset_reader(x)
    return tiff_reader(x) if x["kind"] == "tiff" else raw_reader(x)


def tiff_reader(x: dict):
    fetch, size = opened(x["uri"])
    image = geotiff.Image(fetch, size, x["uri"])
    return lambda r0, r1, c0, c1: [image.read(r0, r1, c0, c1)]


def raw_reader(x: dict):
    """Bands of raw files, each of its own file, offset and strides; a complex band gives its two parts."""
    files = {}
    rows, cols = x["shape"]
    for b in x["bands"]:
        if b["uri"] not in files:
            files[b["uri"]] = opened(b["uri"])
        end = b["offset"] + (rows - 1) * b["line"] + (cols - 1) * b["pixel"] + np.dtype(b["type"]).itemsize
        if min(b["offset"], b["line"], b["pixel"]) < 0 or end > files[b["uri"]][1]:
            raise RasterError(f"{b['uri']}: {files[b['uri']][1]} bytes are fewer than the {end} that its description needs")

    def read(r0: int, r1: int, c0: int, c1: int) -> list[np.ndarray]:
        out = []
        for b in x["bands"]:
            size = np.dtype(b["type"]).itemsize
            first = b["offset"] + r0 * b["line"] + c0 * b["pixel"]
            data = files[b["uri"]][0](first, (r1 - r0 - 1) * b["line"] + (c1 - c0 - 1) * b["pixel"] + size)
            grid = np.ndarray((r1 - r0, c1 - c0), b["type"], data, 0, (b["line"], b["pixel"]))
            out += [grid.real.astype(float), grid.imag.astype(float)] if grid.dtype.kind == "c" else [grid]
        return out

    return read


def tiffs(spark: SparkSession, paths: list[str]) -> list[dict] | None:
    """Descriptions of GeoTIFF files for scan(), from their headers, which tasks read; None if tasks have no client for the store."""
    uris = [store_uri(spark, p) for p in paths]
    if None in uris:
        return None

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    fetch, size = opened(uri)
                except OSError as e:
                    out.append((k, json.dumps({"missing": str(e)})))
                    continue
                image = geotiff.Image(fetch, size, uri)
                out.append((k, json.dumps({"kind": "tiff", "uri": uri, "shape": image.shape, "step": image.step, "meta": asdict(image.meta)})))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out])], ["k", "x"])

    rows = spark.createDataFrame(list(enumerate(uris)), "k long, uri string").repartition(max(1, min(len(uris), 4096)), "k")
    found = {r.k: json.loads(r.x) for r in rows.mapInArrow(describe, "k long, x string").collect()}  # a row a file
    for k, x in found.items():
        if "missing" in x:
            raise StackIOError(f"{paths[k]}: no such file")
    return [found[k] for k in range(len(uris))]


def raw(shape: tuple[int, int], bands: list[dict]) -> dict:
    """Description of a layer of raw bands: uri, type (numpy's), offset, line and pixel (bytes) of each."""
    return {"kind": "raw", "shape": list(shape), "step": [1, shape[1]], "bands": bands}


def meta_of(described: dict) -> Meta:
    m = described["meta"]
    return Meta(**m | {"transform": tuple(m["transform"])})


def scan(spark: SparkSession, layers: list[dict], values: list[str], index: str = "layer", block: int | None = None) -> DataFrame:
    """row, col, index (the layer's place), values (double, NULL for NoData and anything not finite) of described layers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    return spark.read.format("fringeflow-raster").options(layers=json.dumps(layers), values=json.dumps(values), index=index, block=str(block or BLOCK)).load()


# --- writing ---


@dataclass(frozen=True)
class Written(WriterCommitMessage):
    tiles: dict[str, list[int]]


class TileSink(DataSource):
    """Options: `folder` (file: URI), `shape` and `meta` (JSON), `tile`, `stamp`; rows: name, place (the tile's number), data (its pixels as Float32)."""

    @classmethod
    def name(cls) -> str:
        return "fringeflow-geotiff"

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options))


class TileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.stamp, self.tile = options["folder"].removeprefix("file://"), options["stamp"], int(options["tile"])
        self.shape, meta = tuple(json.loads(options["shape"])), json.loads(options["meta"])
        self.meta = Meta(**meta | {"transform": tuple(meta["transform"])})
        self.big = {"true": True, "false": False}.get(options.get("big", ""))

    def _part(self, name: str) -> str:
        return f"{self.folder}/.{name}.{self.stamp}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Every tile at its own place: a task that runs again writes the same bytes there."""
        start = len(geotiff.tiled_header(self.shape, self.meta, self.tile, big=self.big))
        done: dict[str, list[int]] = {}
        files: dict[str, int] = {}
        os.makedirs(self.folder, exist_ok=True)
        try:
            for b in iterator:
                for name, place, data in zip(b.column("name").to_pylist(), b.column("place").to_pylist(), b.column("data").to_pylist(), strict=True):
                    if name not in files:
                        if len(files) >= OPEN:
                            os.close(files.pop(next(iter(files))))
                        files[name] = os.open(self._part(name), os.O_WRONLY | os.O_CREAT, 0o644)
                    at, left = start + place * self.tile * self.tile * 4, memoryview(data)
                    while left:
                        n = os.pwrite(files[name], left, at)
                        at, left = at + n, left[n:]
                    done.setdefault(name, []).append(place)
        finally:
            for f in files.values():
                os.close(f)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        tiles: dict[str, list[int]] = {}
        for m in messages:
            for name, places in (m.tiles if m else {}).items():
                tiles.setdefault(name, []).extend(places)
        for name, places in tiles.items():
            with open(self._part(name), "r+b") as f:
                f.write(geotiff.tiled_header(self.shape, self.meta, self.tile, np.array(places), self.big))
            os.replace(self._part(name), f"{self.folder}/{name}.tif")
        with open(f"{self.folder}/.{self.stamp}.names", "w") as f:
            json.dump(sorted(tiles), f)

    def abort(self, messages: list[Written | None]) -> None:
        for x in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            if x.endswith(f".{self.stamp}.part"):
                os.remove(f"{self.folder}/{x}")


def write_tiles(rows: DataFrame, name: str, value: str, shape: tuple[int, int], meta: Meta, folder: str, tile: int | None = None, big: bool | None = None) -> list[str]:
    """A tiled GeoTIFF for each value of the column `name`, in a folder that tasks reach as files; a task holds one tile at a time.

    Tiles without rows take no room. Rows outside the shape raise an error, of rows that repeat a pixel one is taken; names without rows have no file.
    """
    spark = rows.sparkSession
    uri = store_uri(spark, folder)
    if uri is None or not uri.startswith("file://"):
        raise StackIOError(f"{folder}: not a folder of files")
    tile = tile or min(TILE, -(-max(shape) // 16) * 16)
    across = -(-shape[1] // tile)

    def one(t: pa.Table) -> pa.Table:
        place = t["place"][0].as_py()
        grid = np.full((tile, tile), np.nan, "<f4")
        grid[t["row"].to_numpy() - place // across * tile, t["col"].to_numpy() - place % across * tile] = t["v"].to_numpy(zero_copy_only=False).astype("<f4")
        return pa.table({"name": [t["name"][0].as_py()], "place": [place], "data": pa.array([grid.tobytes()], pa.binary())})

    inside = F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1)
    place = F.when(inside, F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)).otherwise(F.raise_error(F.lit("a pixel is outside the raster")).cast("long"))
    cells = rows.select(F.col(name).cast("string").alias("name"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("v")).withColumn("place", place.cast("long"))
    spark.dataSource.register(TileSink)
    options = {"folder": uri, "shape": json.dumps(shape), "meta": json.dumps(asdict(meta)), "tile": str(tile), "stamp": uuid.uuid4().hex, "big": "" if big is None else str(big).lower()}
    os.makedirs(uri.removeprefix("file://"), exist_ok=True)
    cells.groupBy("name", "place").applyInArrow(one, "name string, place long, data binary").write.format("fringeflow-geotiff").options(**options).mode("append").save()
    told = f"{uri.removeprefix('file://')}/.{options['stamp']}.names"  # what the commit has named
    with open(told) as f:
        names = json.load(f)
    os.remove(told)
    return [f"{folder}/{n}.tif" for n in names]
