"""Chunked scientific files (HDF5 with the superblock and groups that are written by default): datasets by ranges of elements.

Only what a range touches is read: the chunk index is descended by its keys, and the chunks that the
range meets are fetched and unfiltered (byte shuffle, Deflate, Fletcher checksum).
"""

from __future__ import annotations

import itertools
import json
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, MetadataError, RasterError, UnsupportedFormat
from fringeflow.functions.phase import WAVELENGTH_M
from fringeflow.operators.cube import Meta, Pair, Stack, check_pairs, to_pixels
from fringeflow.sources.files import opened, store_uri

# Signatures, message types and filters of the format.
_SIGNATURE, _NODE, _HEAP, _SYMBOLS = b"\x89HDF\r\n\x1a\n", b"TREE", b"HEAP", b"SNOD"
_SPACE, _TYPE, _LAYOUT, _FILTERS, _MORE, _TABLE = 1, 3, 8, 11, 16, 17
_DEFLATE, _SHUFFLE, _FLETCHER = 1, 2, 3
_NOWHERE = (1 << 64) - 1


def _messages(fetch: Callable[[int, int], bytes], at: int) -> dict[int, bytes]:
    """Messages of an object by type; of repeated types the first."""
    head = fetch(at, 16)
    if head[:1] != b"\x01":
        raise UnsupportedFormat("object headers of the newer kind")
    count, size = struct.unpack_from("<H", head, 2)[0], struct.unpack_from("<I", head, 8)[0]
    out, blocks = {}, [fetch(at + 16, size)]
    for block in blocks:
        p = 0
        while p + 8 <= len(block) and count > 0:
            kind, n = struct.unpack_from("<HH", block, p)
            data = block[p + 8 : p + 8 + n]
            out.setdefault(kind, data)
            if kind == _MORE:
                blocks.append(fetch(*struct.unpack_from("<QQ", data)))
            p, count = p + 8 + n, count - 1
    return out


def _entries(fetch: Callable[[int, int], bytes], table: bytes) -> Iterator[tuple[str, int]]:
    """Names and object addresses of a group."""
    tree, heap = struct.unpack_from("<QQ", table)
    head = fetch(heap, 32)
    if head[:4] != _HEAP:
        raise RasterError("damaged group")
    size, _, at = struct.unpack_from("<QQQ", head, 8)
    names, nodes = fetch(at, size), [tree]
    while nodes:
        head = fetch(nodes[0], 24)
        if head[:4] != _NODE:
            raise RasterError("damaged group")
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        children = struct.unpack_from(f"<{2 * n + 1}Q", fetch(nodes.pop(0) + 24, 8 * (2 * n + 1)))[1::2]
        if level:
            nodes += children
            continue
        for child in children:
            many = struct.unpack_from("<H", fetch(child, 8), 6)[0]
            body = fetch(child + 8, 40 * many)
            for k in range(many):
                name, address = struct.unpack_from("<QQ", body, 40 * k)
                yield names[name : names.index(b"\0", name)].decode(), address


class Dataset:
    """A dataset of whole or floating-point numbers, contiguous or in chunks."""

    def __init__(self, fetch: Callable[[int, int], bytes], path: str):
        self.fetch = fetch
        head = fetch(0, 96)
        if head[:8] != _SIGNATURE:
            raise RasterError("not an HDF5 file")
        if head[8] > 1 or head[13:15] != b"\x08\x08":
            raise UnsupportedFormat("a superblock of the newer kind")
        at = struct.unpack_from("<Q", head, 64 + 4 * (head[8] == 1))[0]
        for name in path.strip("/").split("/"):
            table = _messages(fetch, at).get(_TABLE)
            at = dict(_entries(fetch, table)).get(name) if table else None
            if at is None:
                raise MetadataError(f"there is no {path}")
        m = _messages(fetch, at)
        try:
            self._describe(m)
        except (KeyError, struct.error, IndexError) as e:
            raise RasterError(f"{path}: damaged or no dataset") from e

    def _describe(self, m: dict[int, bytes]) -> None:
        space, kind, layout = m[_SPACE], m[_TYPE], m[_LAYOUT]
        self.shape = struct.unpack_from(f"<{space[1]}Q", space, 8 if space[0] == 1 else 4)
        size = struct.unpack_from("<I", kind, 4)[0]
        if kind[0] & 15 not in (0, 1) or size not in (1, 2, 4, 8):
            raise UnsupportedFormat("only whole and floating-point numbers are read")
        code = "f" if kind[0] & 15 == 1 else "i" if kind[1] & 8 else "u"
        self.kind = np.dtype(f"{'>' if kind[1] & 1 else '<'}{code}{size}")
        if layout[0] != 3 or layout[1] not in (1, 2):
            raise UnsupportedFormat("only contiguous and chunked layouts of version 3 are read")
        if layout[1] == 1:
            self.chunks, (self.address,) = None, struct.unpack_from("<Q", layout, 2)
        else:
            n = layout[2] - 1
            self.address, self.chunks = struct.unpack_from("<Q", layout, 3)[0], struct.unpack_from(f"<{n}I", layout, 11)
        self.filters = []
        if _FILTERS in m:
            f = m[_FILTERS]
            p = 8 if f[0] == 1 else 2
            for _ in range(f[1]):
                kind = struct.unpack_from("<H", f, p)[0]
                named = f[0] == 1 or kind >= 256
                length = struct.unpack_from("<H", f, p + 2)[0] if named else 0
                values = struct.unpack_from("<H", f, p + (6 if named else 4))[0]
                p += (8 if named else 6) + (length + 7) // 8 * 8 * (f[0] == 1) + length * (f[0] != 1) + 4 * values + 4 * (values % 2) * (f[0] == 1)
                if kind not in (_DEFLATE, _SHUFFLE, _FLETCHER):
                    raise UnsupportedFormat(f"filter {kind}")
                self.filters.append(kind)

    def _unfiltered(self, raw: bytes, skipped: int) -> np.ndarray:
        for k, f in reversed(list(enumerate(self.filters))):
            if skipped >> k & 1:
                continue
            if f == _FLETCHER:
                raw = raw[:-4]
            elif f == _DEFLATE:
                try:
                    raw = zlib.decompress(raw)
                except zlib.error as e:
                    raise RasterError("damaged chunk") from e
            else:
                raw = np.frombuffer(raw, np.uint8).reshape(self.kind.itemsize, -1).T.tobytes()
        if len(raw) < math.prod(self.chunks) * self.kind.itemsize:
            raise RasterError("damaged chunk")
        return np.frombuffer(raw, self.kind, math.prod(self.chunks)).reshape(self.chunks)

    def _chunks(self, low: list[int], high: list[int]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(start, address, bytes, filters skipped) of the chunks that meet low .. high (exclusive): nodes whose keys lie apart are not opened."""
        n, nodes = len(self.shape), [self.address] if self.address != _NOWHERE else []
        width = 8 + 8 * (n + 1)
        while nodes:
            head = self.fetch(nodes[0], 24)
            if head[:4] != _NODE or head[4] != 1:
                raise RasterError("damaged chunk index")
            level, many = head[5], struct.unpack_from("<H", head, 6)[0]
            body = self.fetch(nodes.pop(0) + 24, many * (width + 8) + width)
            keys = [struct.unpack_from(f"<II{n}Q", body, k * (width + 8)) for k in range(many + 1)]
            for k in range(many):
                child = struct.unpack_from("<Q", body, k * (width + 8) + width)[0]
                start, following = keys[k][2:], keys[k + 1][2:]
                if level:  # keys are ordered by the first axis, then the next
                    if start[0] < high[0] and following[0] + self.chunks[0] > low[0]:
                        nodes.append(child)
                elif all(s < h and s + c > a for s, c, a, h in zip(start, self.chunks, low, high, strict=True)):
                    yield start, child, keys[k][0], keys[k][1]

    def read(self, low: list[int] | None = None, high: list[int] | None = None) -> np.ndarray:
        """Elements low .. high (exclusive) as float64; NaN where no chunk was written."""
        low = [0] * len(self.shape) if low is None else low
        high = list(self.shape) if high is None else [min(h, n) for h, n in zip(high, self.shape, strict=True)]
        out = np.full([max(0, h - a) for a, h in zip(low, high, strict=True)], np.nan)
        if not out.size or self.address == _NOWHERE:
            return out
        if self.chunks is None:  # runs of whole rows
            row = math.prod(self.shape[1:])
            first, last = (low[0] * row, high[0] * row) if self.shape else (0, 1)
            raw = self.fetch(self.address + first * self.kind.itemsize, (last - first) * self.kind.itemsize)
            if len(raw) < (last - first) * self.kind.itemsize:
                raise RasterError("shorter than its size says")
            part = np.frombuffer(raw, self.kind).reshape((-1, *self.shape[1:]) if self.shape else ())
            return part[tuple([slice(None), *(slice(a, h) for a, h in zip(low[1:], high[1:], strict=True))])].astype(float) if self.shape else part.astype(float)
        for start, address, size, skipped in self._chunks(low, high):
            chunk = self._unfiltered(self.fetch(address, size), skipped)
            here = [slice(max(s, a) - s, min(s + c, h) - s) for s, c, a, h in zip(start, self.chunks, low, high, strict=True)]
            there = [slice(max(s, a) - a, min(s + c, h) - a) for s, c, a, h in zip(start, self.chunks, low, high, strict=True)]
            out[tuple(there)] = chunk[tuple(here)]
        return out


def encode(datasets: dict[str, tuple[np.ndarray, tuple[int, ...] | None]], fan: int = 16) -> bytes:
    """A file of datasets by path: each an array and its chunks (shuffled and deflated; None: contiguous). For exports and fixtures."""
    out = bytearray(96)

    def put(data: bytes) -> int:
        out.extend(b"\0" * (-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def header(messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(data) + -len(data) % 8, 0) + data + b"\0" * (-len(data) % 8) for kind, data in messages)
        return put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def node(kind: int, level: int, keys: list[bytes], children: list[int]) -> int:
        body = b"".join(k + struct.pack("<Q", c) for k, c in zip(keys, children, strict=False)) + keys[-1]
        return put(_NODE + struct.pack("<BBHQQ", kind, level, len(children), _NOWHERE, _NOWHERE) + body)

    def dataset(x: np.ndarray, chunks: tuple[int, ...] | None) -> int:
        size, n = x.dtype.itemsize, x.ndim
        flags = (1 if x.dtype.str[0] == ">" else 0) | (8 if x.dtype.kind == "i" else 0)
        kind = struct.pack("<BBBBI", 0x10 | (x.dtype.kind == "f"), flags, 0, 0, size) + (struct.pack("<HHBBBBI", 0, 8 * size, 52 if size == 8 else 23, 11 if size == 8 else 8, 0, 52 if size == 8 else 23, 1023 if size == 8 else 127) if x.dtype.kind == "f" else struct.pack("<HH", 0, 8 * size))
        messages = [(_SPACE, struct.pack(f"<BBB5x{n}Q", 1, n, 0, *x.shape)), (_TYPE, kind)]
        if chunks is None:
            return header([*messages, (_LAYOUT, struct.pack("<BBQQ", 3, 1, put(np.ascontiguousarray(x).tobytes()), x.nbytes))])
        keys, children = [], []
        for start in itertools.product(*(range(0, s, c) for s, c in zip(x.shape, chunks, strict=True))):
            part = np.zeros(chunks, x.dtype)
            own = x[tuple(slice(s, s + c) for s, c in zip(start, chunks, strict=True))]
            part[tuple(slice(0, k) for k in own.shape)] = own
            raw = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, size).T.tobytes())
            keys.append(struct.pack(f"<II{n + 1}Q", len(raw), 0, *start, 0))
            children.append(put(raw))
        end = struct.pack(f"<II{n + 1}Q", 0, 0, *x.shape, 0)
        level = 0
        while True:
            groups = [(keys[k : k + fan] + [(keys + [end])[min(k + fan, len(keys))]], children[k : k + fan]) for k in range(0, len(keys), fan)]
            children, keys = [node(1, level, *g) for g in groups], [g[0][0] for g in groups]
            level += 1
            if len(children) <= 1:
                break
        filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", _SHUFFLE, 0, 0, 1, size) + struct.pack("<HHHHI4x", _DEFLATE, 0, 0, 1, 6)
        return header([*messages, (_LAYOUT, struct.pack(f"<BBBQ{n + 1}I", 3, 2, n + 1, children[0] if children else _NOWHERE, *chunks, size)), (_FILTERS, filters)])

    def group(tree: dict) -> int:
        heap, rows = bytearray(8), []
        for name in sorted(tree):
            at = group(tree[name]) if isinstance(tree[name], dict) else dataset(*tree[name])
            rows.append((len(heap), at))
            heap += name.encode() + b"\0" * (8 - len(name.encode()) % 8)
        names = put(bytes(heap))
        where = put(_HEAP + struct.pack("<B3xQQQ", 0, len(heap), _NOWHERE, names))
        symbols = put(_SYMBOLS + struct.pack("<BBH", 1, 0, len(rows)) + b"".join(struct.pack("<QQII16x", name, at, 0, 0) for name, at in rows))
        return header([(_TABLE, struct.pack("<QQ", node(0, 0, [struct.pack("<Q", 0), struct.pack("<Q", rows[-1][0])], [symbols]), where))])

    tree: dict = {}
    for path, what in datasets.items():
        *above, name = path.strip("/").split("/")
        at = tree
        for g in above:
            at = at.setdefault(g, {})
        at[name] = what
    root = group(tree)
    out[:96] = _SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, _NOWHERE, len(out), _NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
    return bytes(out)


def dataset_reader(x: dict):
    """For raster.scan: a 2-D dataset, or a part of it from `origin` on; where `valid` names a second dataset, only where that is above 0."""
    fetch, _ = opened(x["uri"])
    data = [Dataset(fetch, p) for p in (x["dataset"], *([x["valid"]] if x.get("valid") else []))]
    top, left = x.get("origin", (0, 0))

    def read(r0: int, r1: int, c0: int, c1: int) -> list[np.ndarray]:
        got = [d.read([top + r0, left + c0], [top + r1, left + c1]) for d in data]
        return [got[0] if len(got) == 1 else np.where(got[1] > 0, got[0], np.nan)]

    return read


# Where the products keep their grids.
PHASE, COHERENCE, COMPONENTS = "science/grids/data/unwrappedPhase", "science/grids/data/coherence", "science/grids/data/connectedComponents"
LONGITUDE, LATITUDE, BASELINE = "science/grids/data/longitude", "science/grids/data/latitude", "science/grids/imagingGeometry/perpendicularBaseline"


def dates_of(name: str) -> tuple[date, date]:
    """Reference and secondary date of a product's file name: `...-tops-SECONDARY_REFERENCE-...`."""
    try:
        later, earlier = name.rpartition("/")[2].split("-tops-")[1].split("-")[0].split("_")
        return tuple(datetime.strptime(d, "%Y%m%d").date() for d in (earlier, later))
    except (IndexError, ValueError) as e:
        raise MetadataError(f"{name}: no dates in the name") from e


def read_products(spark: SparkSession, paths: list[str], window: tuple[float, float, float, float] | None = None) -> tuple[Stack, list[str]]:
    """Unwrapped products as a stack over window (west, south, east, north; the first file's whole grid if None), and the files that do not cover it, which are left out.

    Phase counts only where the connected component is above 0; each file is cropped from its own node nearest to
    the window's corner, so grids may be shifted against each other; baselines are the mean of each file's grid. Headers,
    coordinates and baselines are read by tasks, data by blocks of rows. Of files for the same pair the last by name counts.
    """
    from fringeflow.sources import raster

    if not paths:
        raise MetadataError("no products")
    paths = sorted(paths)
    uris = [store_uri(spark, p) for p in paths]
    if None in uris:
        raise UnsupportedFormat("tasks have no client for the products' store")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fetch, _ = opened(uri)
                d = Dataset(fetch, PHASE)
                with np.errstate(all="ignore"):
                    base = Dataset(fetch, BASELINE).read()
                    out.append((k, json.dumps({"shape": d.shape, "chunks": d.chunks, "lon": Dataset(fetch, LONGITUDE).read().tolist(), "lat": Dataset(fetch, LATITUDE).read().tolist(), "baseline": float(np.nanmean(base)) if np.isfinite(base).any() else 0.0})))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out])], ["k", "x"])

    rows = spark.createDataFrame(list(enumerate(uris)), "k long, uri string").repartition(max(1, min(len(uris), 4096)), "k")
    about = {r.k: json.loads(r.x) for r in rows.mapInArrow(describe, "k long, x string").collect()}  # a row a file: its two axes
    lon, lat = np.array(about[0]["lon"]), np.array(about[0]["lat"])
    west, south, east, north = window or (lon.min(), lat.min(), lon.max(), lat.max())
    cx, cy = np.flatnonzero((lon >= west) & (lon <= east)), np.flatnonzero((lat >= south) & (lat <= north))
    if len(cx) < 2 or len(cy) < 2:
        raise DimensionMismatch("the window has fewer than two columns or rows of the first product")
    cols, height, corner = len(cx), len(cy), (lon[cx[0]], lat[cy[0]])
    step = abs(lon[1] - lon[0]), abs(lat[1] - lat[0])
    found, left = {}, []
    for k, p in enumerate(paths):
        own, up = np.array(about[k]["lon"]), np.array(about[k]["lat"])
        x, y = int(np.argmin(np.abs(own - corner[0]))), int(np.argmin(np.abs(up - corner[1])))
        if x + cols > len(own) or y + height > len(up) or abs(own[x] - corner[0]) > 1.5 * step[0] or abs(up[y] - corner[1]) > 1.5 * step[1]:
            left.append(p)
            continue
        found[dates_of(p)] = (k, (y, x))
    if not found:
        raise MetadataError("no product covers the window")
    epochs = tuple(sorted({d for pair in found for d in pair}))
    order = sorted(found)
    pairs = tuple(Pair(epochs.index(a), epochs.index(b), about[found[a, b][0]]["baseline"]) for a, b in order)
    check_pairs(pairs, len(epochs))

    def layer(pair: tuple[date, date], dataset: str, valid: str | None) -> dict:
        k, origin = found[pair]
        chunk = about[k]["chunks"] or (1, about[k]["shape"][1])
        return {"kind": "hdf5", "uri": uris[k], "dataset": dataset, "valid": valid, "origin": origin, "shape": [height, cols], "step": [min(chunk[0], height), min(chunk[1], cols)]}

    phase = raster.scan(spark, [layer(p, PHASE, COMPONENTS) for p in order], ["phase"], "pair_idx")
    coh = raster.scan(spark, [layer(p, COHERENCE, None) for p in order], ["coh"], "pair_idx")
    long = phase.withColumn("coh", F.lit(None).cast("double")).unionByName(coh.withColumn("phase", F.lit(None).cast("double")))
    px: DataFrame = to_pixels(long, "pair_idx", len(pairs), phase="phase", coh="coh")
    meta = Meta((float(corner[0]), float(corner[1]), float(lon[1] - lon[0]), float(lat[1] - lat[0])), "EPSG:4326", WAVELENGTH_M, 39.0)
    return Stack(px, epochs, pairs, (height, cols), meta), left
