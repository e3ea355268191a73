"""GeoTIFF files: a reader of one band, in strips or tiles, plain or compressed, and a plain single-precision writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, RasterError, UnsupportedFormat
from fringeflow.operators.cube import Meta
from fringeflow.sources.files import pixels_of, reader, store_uri, write_bytes, writer

# TIFF tags and the sizes of their types.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS_PER_STRIP, _COUNTS, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
_PLANAR, _PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS = 284, 317, 322, 323, 324, 325
_PIXEL_SCALE, _TIEPOINT, _GEO_KEYS, _NODATA = 33550, 33922, 34735, 42113
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


def _ifd(tags: list[tuple[int, str, tuple | bytes]], big: bool) -> bytes:
    """A little-endian header with one directory; everything stands at the start of the file."""
    kinds = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    head, entry, word = (16, 20, 8) if big else (8, 12, 4)
    at = head + (8 if big else 2) + entry * len(tags) + word
    entries, extra = b"", b""
    for tag, kind, values in tags:
        raw = values if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        if len(raw) <= word:
            field = raw.ljust(word, b"\0")
        else:
            field, extra = struct.pack("<Q" if big else "<I", at + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHQ" if big else "<HHI", tag, kinds[kind], len(values)) + field
    first = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) if big else struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags))
    return first + entries + b"\0" * word + extra


def _describing(shape: tuple[int, int], meta: Meta) -> list[tuple[int, str, tuple | bytes]]:
    x, y, w, h = meta.transform
    epsg = int(meta.crs.split(":")[1]) if meta.crs and meta.crs.upper().startswith("EPSG:") else None
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg) if epsg else (1, 1, 0, 1, 1024, 0, 1, 1)
    return [
        (_WIDTH, "I", (shape[1],)), (_HEIGHT, "I", (shape[0],)), (_BITS, "H", (32,)), (_COMPRESSION, "H", (1,)), (_PHOTOMETRIC, "H", (1,)), (_SAMPLES, "H", (1,)), (_FORMAT, "H", (3,)),
        (_PIXEL_SCALE, "d", (abs(w), abs(h), 0.0)), (_TIEPOINT, "d", (0.0, 0.0, 0.0, x, y, 0.0)), (_GEO_KEYS, "H", keys), (_NODATA, "s", b"nan\0"),
    ]


def encode(grid: np.ndarray, meta: Meta) -> bytes:
    """A little-endian Float32 file of one strip, NaN for NoData."""
    data = np.ascontiguousarray(grid, "<f4").tobytes()

    def head(at: int) -> bytes:
        return _ifd(sorted([*_describing(grid.shape, meta), (_OFFSETS, "I", (at,)), (_ROWS_PER_STRIP, "I", (grid.shape[0],)), (_COUNTS, "I", (len(data),))]), False)

    return head(len(head(0))) + data


def tiled_header(shape: tuple[int, int], meta: Meta, tile: int, have: np.ndarray | None = None, big: bool | None = None) -> bytes:
    """The header of a Float32 file whose square tiles stand behind it at fixed places, those in `have` (all, if None); the others are NoData.

    Its length depends on the shape alone, so tiles can be written before it. Files of 4 GiB and more have 64-bit offsets.
    """
    n, size = -(-shape[0] // tile) * -(-shape[1] // tile), tile * tile * 4
    big = n * (size + 16) + 4096 >= 1 << 32 if big is None else big
    kind = "Q" if big else "I"

    def head(at: int) -> bytes:
        there = np.ones(n, bool)
        if have is not None:
            there = np.isin(np.arange(n), have)
        offsets = np.where(there, at + size * np.arange(n, dtype=np.int64), 0)
        return _ifd(sorted([*_describing(shape, meta), (_TILE_WIDTH, "I", (tile,)), (_TILE_HEIGHT, "I", (tile,)), (_TILE_OFFSETS, kind, tuple(offsets.tolist())), (_TILE_COUNTS, kind, tuple(np.where(there, size, 0).tolist()))]), big)

    length = len(head(0))
    return head(length + -length % 16).ljust(length + -length % 16, b"\0")


def directory(fetch: Callable[[int, int], bytes], path: str = "") -> tuple[str, dict[int, tuple | bytes]]:
    """Byte order and tags of the first image, classic or with 64-bit offsets; fetch(start, length) gives bytes of the file (fewer at its end)."""
    try:
        head = fetch(0, 16)
        order = {b"II": "<", b"MM": ">"}[head[:2]]
        magic, at = struct.unpack(order + "HI", head[2:8])
        word, entry, many = "I", "HHI", "H"
        if magic == 43:
            size, _, at = struct.unpack(order + "HHQ", head[4:16])
            if size != 8 or not at:
                raise UnsupportedFormat(f"{path}: no image with offsets of 8 bytes")
            word, entry, many = "Q", "HHQ", "Q"
        elif magic != 42:
            raise UnsupportedFormat(f"{path}: not a TIFF")
        wide, step = struct.calcsize(order + word), struct.calcsize(order + entry) + struct.calcsize(order + word)
        (n,) = struct.unpack(order + many, fetch(at, struct.calcsize(order + many)))
        if n > 1 << 16:
            raise RasterError(f"{path}: damaged TIFF header")
        entries, tags = fetch(at + struct.calcsize(order + many), step * n), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + entry, entries, step * k)
            if kind not in _SIZES:
                continue
            code = _SIZES[kind]
            size = struct.calcsize(code) * count
            raw = entries[step * (k + 1) - wide : step * (k + 1)]
            if size > wide:
                raw = fetch(struct.unpack(order + word, raw)[0], size)
            tags[tag] = raw[:count] if code == "s" else struct.unpack(f"{order}{count}{code}", raw[:size])
    except (KeyError, struct.error) as e:
        raise RasterError(f"{path}: damaged TIFF header") from e
    if not {_WIDTH, _HEIGHT} <= tags.keys():
        raise RasterError(f"{path}: damaged TIFF header")
    return order, tags


def _about(tags: dict) -> tuple[tuple[int, int], Meta]:
    sx, sy = tags.get(_PIXEL_SCALE, (1.0, 1.0, 0.0))[:2]
    tie = tags.get(_TIEPOINT, (0.0,) * 6)
    keys = tags.get(_GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), None)
    return (tags[_HEIGHT][0], tags[_WIDTH][0]), Meta(transform=(tie[3], tie[4], sx, -sy), crs=f"EPSG:{epsg}" if epsg else None)


def unpacked_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first; 256 starts anew, 257 ends."""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    known, out, bits, held, width, before = table[:], [], 0, 0, 9, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            known, width, before = table[:], 9, None
            continue
        if before is None:
            now = known[code]
        else:
            now = known[code] if code < len(known) else before + before[:1]
            known.append(before + now[:1])
        out.append(now)
        before = now
        width = 9 + (len(known) >= 511) + (len(known) >= 1023) + (len(known) >= 2047)
    return b"".join(out)


def _block(raw: bytes, compression: int, need: int, path: str) -> bytes:
    try:
        data = raw if compression == 1 else zlib.decompress(raw) if compression in (8, 32946) else unpacked_lzw(raw)
    except (zlib.error, IndexError) as e:
        raise RasterError(f"{path}: damaged compressed data") from e
    if len(data) < need:
        raise RasterError(f"{path}: shorter than its size says")
    return data[:need]


def _unpredicted(data: bytes, predictor: int, shape: tuple[int, int, int], kind: np.dtype) -> np.ndarray:
    """Samples of a block of (rows, columns, samples), whose rows hold differences where a predictor says so."""
    if predictor == 3:  # bytes of a row's numbers, highest first, plane by plane, each less the one before
        rows, cols, samples = shape
        x = np.frombuffer(data, np.uint8).reshape(rows, -1, samples) if samples > 1 else np.frombuffer(data, np.uint8).reshape(rows, -1, 1)
        x = np.cumsum(x, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * samples)
        return np.ascontiguousarray(x.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    x = np.frombuffer(data, kind).reshape(shape)
    if predictor == 2:
        whole = x.astype(kind.newbyteorder("=")).view(f"u{kind.itemsize}")
        x = np.cumsum(whole, axis=1, dtype=whole.dtype).view(kind.newbyteorder("="))
    return x


class Image:
    """The first band of a file, read by ranges of pixels: strips or tiles, plain, Deflate or LZW. Sizes are checked before anything is allocated."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int, path: str = ""):
        self.fetch, self.path = fetch, path
        order, tags = directory(fetch, path)
        self.shape, self.meta = _about(tags)
        height, width = self.shape
        self.compression, self.predictor = (tags.get(t, (1,))[0] for t in (_COMPRESSION, _PREDICTOR))
        if self.compression not in (1, 5, 8, 32946) or self.predictor not in (1, 2, 3):
            raise UnsupportedFormat(f"{path}: compression {self.compression} with predictor {self.predictor}")
        self.samples = tags.get(_SAMPLES, (1,))[0] if tags.get(_PLANAR, (1,))[0] == 1 else 1
        bits, form = tags.get(_BITS, (1,))[0], tags.get(_FORMAT, (1,))[0]
        kind = {(32, 3): "f4", (64, 3): "f8", (8, 1): "u1", (8, 2): "i1", (16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4"}.get((bits, form))
        if kind is None or (self.predictor == 3 and form != 3):
            raise UnsupportedFormat(f"{path}: {bits}-bit samples of format {form}")
        self.kind = np.dtype(order + kind)
        self.tiled = _TILE_WIDTH in tags
        self.offsets, self.counts = (tags.get(t, ()) for t in ((_TILE_OFFSETS, _TILE_COUNTS) if self.tiled else (_OFFSETS, _COUNTS)))
        self.bw, self.bh = (tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0]) if self.tiled else (width, min(height, tags.get(_ROWS_PER_STRIP, (height,))[0]))
        self.across, down = -(-width // max(1, self.bw)), -(-height // max(1, self.bh))
        plain = self.bw * self.bh * self.samples * self.kind.itemsize
        short = min(width, height, self.bw, self.bh, self.samples) < 1 or min(len(self.offsets), len(self.counts)) < self.across * down
        if short or any(o + c > size for o, c in zip(self.offsets, self.counts, strict=False)):
            raise RasterError(f"{path}: shorter than its size says")
        if plain > 2000 * max(1, max(self.counts)) and any(self.counts):  # no compression here makes so much of so little
            raise RasterError(f"{path}: shorter than its size says")
        nodata = tags.get(_NODATA, b"nan").strip(b"\0 ")
        self.nodata = np.float32(float(nodata)) if nodata and nodata.lower() != b"nan" else None

    @property
    def step(self) -> tuple[int, int]:
        """Rows and columns that are read together at least."""
        return (1, self.shape[1]) if self._by_rows else (self.bh, self.bw)

    @property
    def _by_rows(self) -> bool:
        return not self.tiled and self.compression == 1 and self.predictor == 1

    def read(self, r0: int = 0, r1: int | None = None, c0: int = 0, c1: int | None = None) -> np.ndarray:
        """Rows r0 to r1 and columns c0 to c1 (exclusive) as Float32; of the file only the strips or tiles that hold them are read."""
        r1, c1 = min(self.shape[0], r1 or self.shape[0]), min(self.shape[1], c1 or self.shape[1])
        out = np.full((max(0, r1 - r0), max(0, c1 - c0)), np.nan, np.float32)
        for i in range(r0 // self.bh, -(-r1 // self.bh)):
            for j in range(c0 // self.bw, -(-c1 // self.bw)):
                k, r, c = i * self.across + j, i * self.bh, j * self.bw
                if not self.counts[k]:
                    continue  # a tile that was never written
                rows, at, n = self.bh if self.tiled else min(self.bh, self.shape[0] - r), self.offsets[k], self.counts[k]
                line = self.bw * self.samples * self.kind.itemsize
                if self._by_rows and n < rows * line:
                    raise RasterError(f"{self.path}: shorter than its size says")
                if self._by_rows:
                    first, last = max(r, r0), min(r + rows, r1)
                    at, n, r, rows = at + (first - r) * line, (last - first) * line, first, last - first
                raw = _block(self.fetch(at, n), self.compression, rows * line, self.path)
                block = _unpredicted(raw, self.predictor, (rows, self.bw, self.samples), self.kind)[:, :, 0]
                top, left = max(r, r0), max(c, c0)
                part = block[top - r : r1 - r, left - c : c1 - c]
                out[top - r0 : top - r0 + part.shape[0], left - c0 : left - c0 + part.shape[1]] = part
        return out if self.nodata is None else np.where(out == self.nodata, np.float32(np.nan), out)


def decode(data: bytes, path: str = "") -> tuple[np.ndarray, Meta]:
    """The first band as Float32 and its georeference."""
    image = Image(lambda at, n: data[at : at + n], len(data), path)
    return image.read(), image.meta


def read(spark: SparkSession, paths: list[str], value: str = "value", index: str = "layer") -> DataFrame:
    """row, col, index, value of every pixel of every file; NoData is NULL. A task reads a block of rows or tiles; a whole file only where tasks have no client for the store."""
    from fringeflow.sources import raster

    described = raster.tiffs(spark, paths)
    if described is None:
        return pixels_of(spark, paths, lambda path, data: [decode(data, path)[0].astype(float)], [value], index)
    return raster.scan(spark, described, [value], index)


def headers(spark: SparkSession, paths: list[str]) -> list[tuple[tuple[int, int], Meta]]:
    """Shape and georeference of each file; of each only the header's bytes are read, by tasks where they can."""
    from fringeflow.sources import raster

    described = raster.tiffs(spark, paths)
    if described is not None:
        return [(tuple(x["shape"]), raster.meta_of(x)) for x in described]
    out = []
    for p in paths:
        with reader(spark, p) as fetch:
            out.append(_about(directory(fetch, p)[1]))
    return out


def same_shape(found: list[tuple[tuple[int, int], Meta]]) -> tuple[int, int]:
    shapes = {s for s, _ in found}
    if len(shapes) != 1:
        raise DimensionMismatch(f"rasters of different sizes: {sorted(shapes)}")
    return shapes.pop()


def write_layers(rows: DataFrame, name: str, value: str, shape: tuple[int, int], meta: Meta, folder: str) -> list[str]:
    """A file for each value of the column `name` (the file's name), written tile by tile where tasks reach the folder as files.

    In other stores, which have no writing at a place, a task builds and writes a whole file. Only names reach the driver.
    """
    spark = rows.sparkSession
    if (store_uri(spark, folder) or "").startswith("file://"):
        from fringeflow.sources import raster

        return raster.write_tiles(rows, name, value, shape, meta, folder)
    put, written = writer(spark, folder), []

    def one(t: pa.Table) -> pa.Table:
        grid = np.full(shape, np.nan)
        grid[t["row"].to_numpy(), t["col"].to_numpy()] = t["v"].to_numpy(zero_copy_only=False).astype(float)
        file, data = f"{t['name'][0].as_py()}.tif", encode(grid, meta)
        if put:
            put(file, data)
        return pa.table({"name": [file], "data": pa.array([None if put else data], pa.binary())})

    files = rows.select(F.col(name).cast("string").alias("name"), F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).cast("double").alias("v"))
    for r in files.groupBy("name").applyInArrow(one, "name string, data binary").toLocalIterator():
        if not put:  # a store that tasks have no client for: one file at a time
            write_bytes(spark, f"{folder}/{r['name']}", bytes(r["data"]))
        written.append(f"{folder}/{r['name']}")
    return sorted(written)


def write_map(rows: DataFrame, value: str, shape: tuple[int, int], meta: Meta, path: str) -> None:
    folder, _, name = path.removesuffix(".tif").rpartition("/")
    write_layers(rows.withColumn("__name", F.lit(name)), "__name", value, shape, meta, folder)
