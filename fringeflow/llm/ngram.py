"""N-gram language model: interpolated modified Kneser-Ney, counted in Spark, scored from memory-mapped sorted hash arrays.

Training is two passes. The first counts words, by a 64-bit hash of their bytes, and numbers them,
frequent ones first. The second counts n-grams of the highest order: a task sorts the n-grams of its
texts and sends them, merged and packed, to parts dealt by context; very frequent contexts are
salted by the last word, so no part holds more than its share. A part merges what it gets, writes its
n-grams as one shard of the model, and sends on to the next lower order what that needs: for each
context the sum and the numbers of n-grams seen once, twice and more often, and for each suffix the
number of different words before it (the continuation count). So every order is one shuffle of
packed arrays, all counts cover the whole corpus, and nothing is pruned.

A shard holds its n-grams' hashes sorted: the leading bits choose a bucket, the next 32 are kept in
order, and a code points to the distinct tuples of counts. Workers map shards from the shared folder
(or from an unlinked copy, where that is no file system) and look n-grams up by bisection, a batch
of texts at once. Two n-grams are taken for one with a probability of some 1e-8 a look-up.
"""

from __future__ import annotations

import json
import math
import mmap
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.store import new_path
from fringeflow.llm.suffix import mix
from fringeflow.sources.files import writer

ORDER = 3
#: Bytes of text to a part of the model, tokens that a task gathers before it sends them, and the count from which a context is salted.
PART_BYTES, BUFFER, HOT = 1 << 23, 1 << 20, 1 << 19
#: Bytes of text that are cut into words at once, bytes from which a word is hashed on its own, and n-grams to a bucket.
TILE, LONG_WORD, BUCKET = 1 << 21, 256, 32
#: Bytes of texts and tokens that a task works on at once.
SLICE, WINDOW = 1 << 21, 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.random.default_rng(2).integers(1 << 64, size=256, dtype=np.uint64)[_LOWER]
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FOLD, _SALT = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_END = _U(0x5851F42D4C957F2D)
#: Numbers of the start of a text and of a word that training did not see; words lie between.
_START, _UNKNOWN = 0, (1 << 32) - 1
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 12)
        _powers[:] = [np.cumprod(np.r_[_U(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about TILE bytes that end where a text or a word ends."""
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        to = int(bounds[np.searchsorted(bounds, at + TILE, "right") - 1])
        if to <= at:  # one text of more than TILE bytes
            limit, to = int(bounds[np.searchsorted(bounds, at, "right")]), at + TILE
            while to < limit and not _SPACE[data[to]]:
                gap = np.flatnonzero(_SPACE[data[to : min(limit, to + TILE)]])
                to = to + int(gap[0]) if len(gap) else min(limit, to + TILE)
        yield at, to
        at = to


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the texts data[bounds[i]:bounds[i + 1]], in order; equal but for the case of A-Z, equal hash."""
    hashes, places = [], []
    for s, e in _pieces(data, bounds):
        x = data[s:e]
        ink = ~_SPACE[x]
        opens, closes = ink.copy(), ink.copy()
        opens[1:] &= ~ink[:-1]
        closes[:-1] &= ~ink[1:]
        edge = bounds[np.searchsorted(bounds, s) : np.searchsorted(bounds, e)] - s
        opens[edge] = ink[edge]
        closes[edge[edge > 0] - 1] = ink[edge[edge > 0] - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _power(len(x))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_LETTER[x] * up[: len(x)], out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts])
        for k in np.flatnonzero(ends - starts >= LONG_WORD):
            h[k] = xxhash.xxh64_intdigest(_LOWER[x[starts[k] : ends[k]]].tobytes())
        hashes.append(h)
        places.append(np.searchsorted(bounds, starts + s, "right") - 1)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE bytes of text, one text at least."""
    for b in batches:
        size = np.cumsum(pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
            yield b.slice(at, to - at)
            at = to


def _tokens(column: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, real) of the tokens of a batch: for each text `pad` starts (not real), its words and its end."""
    h, text = words(*_texts(column))
    n = np.bincount(text, minlength=len(column)) + pad + 1
    doc = np.repeat(np.arange(len(column)), n)
    out, real = np.full(len(doc), _END), np.ones(len(doc), bool)
    firsts = np.cumsum(n) - n
    for k in range(pad):
        real[firsts + k] = False
    out[np.arange(len(h)) + text * (pad + 1) + pad] = h
    return out, doc, real


def _places(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): rows in order of their keys, and where in that order each different row begins."""
    k = keys[0].astype(np.uint64)
    for n, key in enumerate(keys[1:]):
        if n:  # two keys fill 64 bits: what they make is numbered before the next one joins
            order = np.argsort(k)
            ranked = k[order]
            k[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]], dtype=np.uint64)
        k = (k << _U(32)) | key
    order = np.argsort(k)
    ranked = k[order]
    return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])


def _sums(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted by keys, those of equal keys added."""
    if not len(values):
        return keys, values
    order, first = _places(keys)
    return [k[order[first]] for k in keys], np.stack([np.add.reduceat(values[order, c], first) for c in range(values.shape[1])], axis=1)


def _counted(ids: np.ndarray, last: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different n-grams that end at places `last` of ids, sorted, and how often each occurs."""
    known, rank = np.unique(ids, return_inverse=True)
    bits = max(1, int(len(known) - 1).bit_length())
    if bits * order > 64:
        keys = [ids[last - (order - 1 - k)] for k in range(order)]
        return _sums(keys, np.ones((len(last), 1), np.uint64))
    rank, k = rank.astype(np.uint64), np.zeros(len(last), np.uint64)
    for n in range(order):
        k = (k << _U(bits)) | rank[last - (order - 1 - n)]
    k.sort()
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    count = np.diff(np.r_[first, len(k)]).astype(np.uint64)
    k = k[first]
    return [known[(k >> _U(bits * (order - 1 - n))) & _U((1 << bits) - 1)] for n in range(order)], count[:, None]


def _least(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _packed(keys: list[np.ndarray], values: np.ndarray) -> bytes:
    planes = [np.diff(keys[0], prepend=np.uint32(0)), *keys[1:], *map(_least, values.T)]
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in map(np.ascontiguousarray, planes))
    sizes = bytes(a.itemsize for a in planes)
    return len(values).to_bytes(8, "little") + bytes([len(keys), len(sizes)]) + sizes + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpacked(blob: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and `width` columns of values; those that the blob has not are 0."""
    n, keys, sizes = int.from_bytes(blob[:8], "little"), blob[8], blob[10 : 10 + blob[9]]
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[10 + len(sizes) :], n * sum(sizes), asbytes=True), np.uint8)
    at, out = 0, []
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(f"<u{size}").ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint32)
    values = np.zeros((n, width), np.uint64)
    for c, column in enumerate(out[keys:]):
        values[:, c] = column
    return out[:keys], values


def _gather(blobs: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [_unpacked(b, width) for b in blobs]
    return _sums([np.concatenate(c) for c in zip(*(k for k, _ in parts), strict=True)], np.concatenate([v for _, v in parts]))


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(parts)) >> _U(32)


def _split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts), "right")
    for p in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(p), order[(ends[p - 1] if p else 0) : ends[p]]


@dataclass(frozen=True)
class Dealing:
    """To which part an n-gram goes. hot: the class of count (power of two) of the most frequent words, by number, from 1."""

    parts: int
    hot: np.ndarray

    def __call__(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(part, hash) of n-grams."""
        h = context = np.full(len(keys[-1]), _FOLD)
        for k in keys:
            context, h = h, mix(h * _FOLD + k + _U(1))
        if len(keys) == 1:
            return _part_of(mix(h), self.parts), h
        rarest = np.maximum.reduce(keys[:-1])
        salted = np.flatnonzero(rarest <= len(self.hot))
        if len(salted) and len(self.hot):
            spread = (_U(2) << self.hot[np.maximum(rarest[salted], 1) - 1].astype(np.uint64)) // _U(HOT) + _U(1)
            context = context.copy()
            context[salted] += (mix(h[salted]) % spread) * _SALT
        return _part_of(mix(context), self.parts), h


def _file(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps({k: [a.dtype.str, list(a.shape)] for k, a in arrays.items()}).encode()
    out = [len(head).to_bytes(8, "little"), head, b"\0" * (-len(head) % 8)]
    for a in arrays.values():
        raw = np.ascontiguousarray(a).tobytes()
        out += [raw, b"\0" * (-len(raw) % 8)]
    return b"".join(out)


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    path = folder.removeprefix("file://").removeprefix("file:")
    if "://" not in path:
        with open(f"{path}/{name}", "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        from pyarrow import fs as stores

        store, at = stores.FileSystem.from_uri(f"{folder.replace('s3a://', 's3://')}/{name}")
        with tempfile.TemporaryFile() as f, store.open_input_stream(at) as source:  # gone from the disk as soon as the map is
            while piece := source.read(1 << 24):
                f.write(piece)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(view[:8], "little")
    at, out = 8 + n + -n % 8, {}
    for key, (kind, shape) in json.loads(view[8 : 8 + n]).items():
        count = math.prod(shape)
        out[key] = np.frombuffer(view, kind, count, at).reshape(shape)
        size = count * np.dtype(kind).itemsize
        at += size + -size % 8
    return out


def _codes(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and for each row which of them it is."""
    if not len(tuples):
        return tuples, np.zeros(0, np.uint8)
    k = tuples[:, 0]
    if tuples.shape[1] > 1:
        k = mix(k + _FOLD)
        for c in range(1, tuples.shape[1]):
            k = mix(k * _FOLD + tuples[:, c])
    elif int(k.max()) < 1 << 16:
        seen = np.flatnonzero(np.bincount(k.astype(np.int64)))
        at = np.zeros(int(k.max()) + 1, np.uint16)
        at[seen] = np.arange(len(seen))
        return seen.astype(np.uint64)[:, None], _least(at[k])
    _, first, code = np.unique(k, return_index=True, return_inverse=True)
    return tuples[first], _least(code)


def _shard(h: np.ndarray, tuples: np.ndarray) -> dict[str, np.ndarray]:
    """A sorted hash array: n-grams by hash, with codes of their tuples of counts."""
    order = np.argsort(h)
    h = h[order]
    bits = max(0, min(31, (max(1, len(h)) // BUCKET).bit_length()))
    distinct, code = _codes(tuples)
    bucket = (h >> _U(64 - bits)) if bits else np.zeros(len(h), np.uint64)
    starts = np.r_[0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=1 << bits))]
    return {"starts": starts.astype(np.uint32), "low": (h >> _U(32 - bits)).astype(np.uint32), "code": code[order], "tuples": distinct}


def _find(shard: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Rows of the shard that have the hashes; -1 where none has."""
    starts, low = shard["starts"], shard["low"]
    if not len(low):
        return np.full(len(h), -1)
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    key = (h >> _U(32 - bits)).astype(np.uint32)
    lo, hi = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
    last = hi
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = low[np.minimum(mid, len(low) - 1)] < key
        less &= lo < hi
        hi = np.where(less | (lo >= hi), hi, mid)
        lo = np.where(less, mid + 1, lo)
    found = (lo < last) & (low[np.minimum(lo, len(low) - 1)] == key)
    return np.where(found, lo, -1)


@dataclass(frozen=True)
class Model:
    """Where the model's files are, and its few numbers. files[0] is the vocabulary's, files[n] that of order n, a name for each part."""

    folder: str
    order: int
    parts: int
    tokens: int
    distinct: int
    hot: tuple[int, ...]
    files: tuple[tuple[str | None, ...], ...]
    discounts: tuple[tuple[float, float, float], ...] = ()
    root: tuple[float, float] = (0.0, 1.0)

    def open(self, n: int, p: int) -> dict[str, np.ndarray] | None:
        if (self.folder, n, p) not in _open:
            for key in [k for k in _open if k[0] != self.folder]:
                del _open[key]
            name = self.files[n][p]
            _open[self.folder, n, p] = None if name is None else _mapped(self.folder, name)
        return _open[self.folder, n, p]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, training count) of words by hash; _UNKNOWN and 0 where training did not see them."""
        number, count = np.full(len(h), _UNKNOWN, np.uint32), np.zeros(len(h), np.int64)
        for p, rows in _split(_part_of(h, self.parts), self.parts):
            if shard := self.open(0, p):
                at = _find(shard, h[rows])
                rows, at = rows[at >= 0], at[at >= 0]
                number[rows] = shard["number"][at]
                count[rows] = shard["count"][at]
        return number, count

    def counts(self, keys: list[np.ndarray]) -> np.ndarray:
        """(n, 3): of each n-gram its count less the discount, and as a context its sum and the share of that which discounts leave to the next lower order."""
        n = len(keys)
        part, h = Dealing(self.parts, np.array(self.hot))(keys)
        out = np.zeros((len(h), 3 if n < self.order else 1))
        for p, rows in _split(part, self.parts):
            if shard := self.open(n, p):
                if "numbers" not in shard:
                    t = shard["tuples"].astype(np.float64)
                    t = np.pad(t, ((0, 0), (0, 5 - t.shape[1])))
                    own = t[:, 0] - np.r_[0.0, self.discounts[n - 1]][np.minimum(t[:, 0], 3).astype(np.int64)]
                    shard["numbers"] = np.stack([own, t[:, 1], t[:, 2:] @ np.array(self.discounts[n])], axis=1) if n < self.order else own[:, None]
                at = _find(shard, h[rows])
                there = at >= 0
                out[rows[there]] = shard["numbers"][shard["code"][at[there]]]
        return out

    def probabilities(self, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        """log10 of the probability of each real token after those before it; ids holds order - 1 starts before each text."""
        out = np.empty(len(ids))
        for s in range(0, len(ids), WINDOW):
            first = max(0, s - self.order)  # what stands before the window's first token
            out[s : s + WINDOW] = self._window(ids[first : s + WINDOW])[s - first :]
        return out[real]

    def _window(self, ids: np.ndarray) -> np.ndarray:
        before, p = None, None
        for n in range(1, self.order + 1):
            c = self.counts([np.r_[np.zeros(min(n - 1 - k, len(ids)), np.uint32), ids[: max(0, len(ids) - (n - 1 - k))]] for k in range(n)])
            if n == 1:
                p = (c[:, 0] + self.root[1] / (self.distinct + 1) * max(self.root[0], 1)) / max(self.root[0], 1)
            else:
                total, rest = before[:, 1], before[:, 2]
                p = np.where(total > 0, (c[:, 0] + rest * p) / np.maximum(total, 1), p)
            before = np.vstack([np.zeros((1, c.shape[1])), c[:-1]])  # the n-gram that ends one token earlier is the context of order n + 1
        return np.log10(p)


_open: dict = {}


def _names(rows: list, parts: int) -> tuple[str | None, ...]:
    out: list[str | None] = [None] * parts
    for r in rows:
        out[r.part] = r.name
    return tuple(out)


def _vocabulary(docs: DataFrame, folder: str, parts: int) -> tuple[tuple[str | None, ...], int, int, tuple[int, ...]]:
    """(files, tokens, distinct words, classes of the frequent words by number): words by hash, counted and numbered, frequent ones first."""
    put = writer(docs.sparkSession, folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def send() -> Iterator[pa.RecordBatch]:
            for p, rows in _split(_part_of(h, parts), parts):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "h": pa.array([h[rows].tobytes()], pa.binary()), "n": pa.array([n[rows].tobytes()], pa.binary())})

        for b in _slices(batches, 0):
            new, many = np.unique(_tokens(b.column(0), 0)[0], return_counts=True)
            h, at = np.unique(np.r_[h, new], return_inverse=True)
            n = np.bincount(at, np.r_[n, many.astype(np.uint64)].astype(np.float64)).astype(np.uint64)
            if len(h) > BUFFER:
                yield from send()
                h, n = h[:0], n[:0]
        if len(h):
            yield from send()

    def merge(group: pa.Table) -> pa.Table:
        h, at = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group["h"].to_pylist()]), return_inverse=True)
        n = np.zeros(len(h), np.uint64)
        np.add.at(n, at, np.concatenate([np.frombuffer(x, np.uint64) for x in group["n"].to_pylist()]))
        part = group["part"][0].as_py()
        name = f"counted-{part}-{uuid.uuid4().hex}"
        put(name, _file({"h": h, "n": n}))
        classes = np.bincount(np.log2(n).astype(np.int64), minlength=64)
        return pa.table({"part": pa.array([part], pa.int32()), "name": [name], "tokens": [int(n.sum())], "classes": [classes.tolist()]})

    found = docs.mapInArrow(count, "part int, h binary, n binary").groupBy("part").applyInArrow(merge, "part int, name string, tokens long, classes array<long>").collect()  # a row a part
    per = np.zeros((64, parts), np.int64)
    for r in found:
        per[:, r.part] = r.classes
    firsts = 1 + np.cumsum(per[::-1].ravel()).reshape(64, parts) - per[::-1]  # by class from the most frequent, then by part
    if per.sum() >= _UNKNOWN - 1:
        raise OverflowError("more than 2**32 different words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, name, first in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                seen = _mapped(folder, name)
                kind = 63 - np.log2(seen["n"]).astype(np.int64)
                order = np.argsort(kind, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(c := np.bincount(kind, minlength=64)) - c, c)
                shard = _shard(seen["h"], np.zeros((len(kind), 1), np.uint64))
                new = f"words-{part}-{uuid.uuid4().hex}"
                put(new, _file({"starts": shard["starts"], "low": shard["low"], "number": (np.array(first)[kind] + rank).astype(np.uint32), "count": seen["n"].astype(np.uint32 if seen["n"].max() < 1 << 32 else np.uint64)}))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [new]})

    spark = docs.sparkSession
    rows = spark.createDataFrame([(r.part, r.name, firsts[:, r.part].tolist()) for r in found], "part int, name string, first array<long>")
    named = rows.repartition(max(1, min(len(found), 10_000))).mapInArrow(number, "part int, name string").collect() if found else []
    hot = [k for k in range(63, -1, -1) if 2 << k > HOT for _ in range(int(per[k].sum()))]
    return _names(named, parts), sum(r.tokens for r in found), int(per.sum()), tuple(hot)


_ROW = "part int, blob binary, level int, name string, seen array<long>"


def _row(part: int, blob: bytes | None, level: int | None = None, name: str | None = None, seen: list | None = None) -> pa.Table:
    kinds = (pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.list_(pa.int64()))
    return pa.table(dict(zip(("part", "blob", "level", "name", "seen"), (pa.array([x], t) for x, t in zip((part, blob, level, name, seen), kinds, strict=True)), strict=True)))


def _blobs(keys: list[np.ndarray], values: np.ndarray, deal: Dealing) -> Iterator[pa.Table]:
    for p, rows in _split(deal(keys)[0], deal.parts):
        rows = np.sort(rows)  # stays in order of the keys
        yield _row(p, _packed([k[rows] for k in keys], values[rows]))


def _merged(n: int, width: int, deal: Dealing, put):
    """Of one part of order n: its shard, and what order n - 1 needs; what is known of higher orders' shards goes along."""

    def merge(group: pa.Table) -> pa.Table:
        told = group.filter(pa.compute.is_valid(group["level"]))
        part = group["part"][0].as_py()
        out = [told]
        if blobs := [x for x in group["blob"].to_pylist() if x is not None]:
            keys, values = _gather(blobs, width)
            counts = values[:, 0]
            name = f"grams{n}-{part}-{uuid.uuid4().hex}"
            put(name, _file(_shard(deal(keys)[1], values)))
            met = np.flatnonzero(counts > 0)
            out.append(_row(part, None, n, name, [*np.bincount(np.minimum(counts[met], 5).astype(np.int64), minlength=6)[1:].tolist(), int(counts.sum())]))
            if n > 1 and len(met):
                keys, counts = [k[met] for k in keys], counts[met]
                first = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys[:-1]])])  # rows of a context stand together
                sums = [np.zeros(len(first), np.uint64)] + [np.add.reduceat(x.astype(np.uint64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]
                out += _blobs([k[first] for k in keys[:-1]], np.stack(sums, axis=1), deal)
                order, first = _places(keys[1:])
                out += _blobs([k[order[first]] for k in keys[1:]], np.diff(np.r_[first, len(order)]).astype(np.uint64)[:, None], deal)
        return pa.concat_tables([t.cast(out[-1].schema) for t in out])

    return merge


def discounts(seen: np.ndarray) -> tuple[float, float, float]:
    """What modified Kneser-Ney takes off counts of 1, 2 and more, from the numbers of n-grams with counts 1 to 4; usual values where those are too few."""
    n = [float(x) for x in seen[:4]]
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = tuple(k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3))
        if all(0 < x <= k + 1 for k, x in enumerate(d)):
            return d
    return 0.5, 1.0, 1.5


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text", part_bytes: int = PART_BYTES) -> Model:
    """The model of all texts of docs; words by white space, A-Z in lower case, and an end for each text.

    Null texts count as empty: an end alone. Rows are texts whether ids or texts repeat or not, other columns are not read.
    An empty table gives a model for which every token has probability 1 (no words are known).
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // part_bytes))
    folder = new_path(spark, "ngrams")
    put = writer(spark, folder)
    if put is None:
        raise OSError(f"{folder}: tasks cannot write files there")
    vocabulary, tokens, distinct, hot = _vocabulary(texts, folder, parts)
    known = Model(folder, order, parts, tokens, distinct, hot, (vocabulary,))
    deal = Dealing(parts, np.array(hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            ids, real = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for t in _blobs(*_counted(ids, np.flatnonzero(real), order), deal):
                yield from t.to_batches()

        for b in _slices(batches, 0):
            h, _, real = _tokens(b.column(0), order - 1)
            held.append((np.where(real, known.words(h)[0], np.uint32(_START)), real))
            if sum(len(x) for x, _ in held) > BUFFER:
                yield from send()
        if held:
            yield from send()

    grams = texts.mapInArrow(count, _ROW)
    for n in range(order, 0, -1):
        grams = grams.groupBy("part").applyInArrow(_merged(n, 1 if n == order else 5, deal, put), _ROW)
    told = grams.select("part", "level", "name", "seen").collect()  # a row for each part and order
    seen = np.zeros((order + 1, 6), np.int64)
    for r in told:
        seen[r.level] += r.seen
    off = tuple(discounts(seen[n]) for n in range(1, order + 1))
    rest = float(np.dot(off[0], [seen[1][0], seen[1][1], seen[1][2:5].sum()])) / max(1, int(seen[1][5]))
    root = (float(seen[1][5]), rest if seen[1][5] else 1.0)
    files = (vocabulary, *(_names([r for r in told if r.level == n], parts) for n in range(1, order + 1)))
    return Model(folder, order, parts, tokens, distinct, hot, files, off, root)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of docs.

    Scores are log10 probabilities of the whole text with its end: `score` the model's, base_score that
    of single words with half a count added. Null texts count as empty; every text has its end, so
    n_tokens is 1 at least and empty texts have a score. Other columns than `keep` are not read; an empty table gives an empty table.
    """
    kinds = dict(docs.dtypes)
    tokens, distinct = model.tokens, model.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, len(first)):
            h, doc, real = _tokens(b.column(b.num_columns - 1), model.order - 1)
            ids, count = model.words(h)
            ids, count, doc = np.where(real, ids, np.uint32(_START)), count[real], doc[real]
            per = lambda x: np.bincount(doc, x, minlength=b.num_rows)  # noqa: E731, B023
            p = per(model.probabilities(ids, real))
            base = per(np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1))))
            n, known = per(None), per((count > 0).astype(np.float64)).astype(np.int64)
            numbers = [pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(b.num_rows, tokens, np.int64)), pa.array(base), pa.array(p), pa.array(10 ** (-p / np.maximum(n, 1)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *numbers], [*b.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    first = [id_col, *keep]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in first), "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"])
    return docs.select(*first, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def score_all(docs: DataFrame) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = train(marked.where(~F.col("held_out")))
    return score(marked, model, keep=("held_out",)).drop("perplexity")
