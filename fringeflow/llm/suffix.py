"""Suffix-array dedup: which bytes lie in a string of `width` bytes that also starts earlier.

A sparse suffix array: in every window of `width` bytes the gram of the least hash is an anchor, so
equal windows share an anchor at the same offset, and only suffixes that start at anchors whose gram
occurs again have to be sorted. Each task sorts its suffixes (with the bytes that their windows have
on the left) and sends front-coded runs: the length that a suffix shares with the one before, and the
rest. The receiving task merges the runs with a loser tree that keeps, for each loser, the prefix
known to be shared with the winner, and never compares those bytes again. The merged order with its
common-prefix lengths decides, for each offset, which windows are equal; all but the earliest are
repeats.

Grams that occur very often do not meet in one task. There the array is dense: each of their windows is a
suffix of its own, cut at `width` bytes; a task first drops those that it has byte for byte already, and the
rest go to sorted, front-coded runs like the others, dealt out by all of their bytes. Equal texts are recognised by digest and only the
earliest takes part. Texts are stored once, bucketed by row, so that joins by row do not move them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.store import discard, drop_path, materialize, new_path

GRAM = 32
#: A gram of more occurrences (in all, or in one task) is dealt out window by window; windows that a task holds before it drops repeats.
HOT, HOT_TASK, HELD = 1024, 64, 1 << 17
#: Bytes that are hashed at once; parts that grams are dealt to, for each shuffle partition at least.
TILE, PARTS = 1 << 20, 4
_U = np.uint64
_P1 = _U(0x9E3779B97F4A7C15)
_MASK = _U(0xFFFFFFFFFFF00000)  # all but the bits of a place in a tile
_SUFFIX, _DONE = 0, 1  # kinds of blobs

_ANCHOR = np.dtype([("gram", "<u8"), ("row", "<i8"), ("at", "<i8"), ("n", "<i4")])
_PLACE = np.dtype([("doc", "<u8"), ("row", "<i8"), ("at", "<i8")])
_SPAN = np.dtype([("row", "<i8"), ("start", "<i8"), ("end", "<i8")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Roller:
    """Hashes of all strings of a length in a tile, from sums of powers modulo 2**64."""

    def __init__(self):
        self.powers = {}

    def __call__(self, x: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
        n = len(x)
        if base not in self.powers or len(self.powers[base][0]) < n:
            size = max(n, 1 << 12)
            inverse = _U(pow(int(base), -1, 1 << 64))
            self.powers[base] = tuple(np.cumprod(np.r_[_U(1), np.full(size, b)]) for b in (base, inverse))
        up, down = self.powers[base]
        sums = np.zeros(n + 1, _U)
        np.cumsum((x.astype(_U) + _U(1)) * up[:n], out=sums[1:])
        return mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def anchors(x: np.ndarray, ends: np.ndarray, roll: Roller, width: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end in x: each anchor's place and gram hash, and the first and last window that it stands for."""
    none = np.zeros(0, np.int64)
    if len(x) < width:
        return none, none.astype(_U), none, none
    gram = roll(x, GRAM, _P1)
    key = (gram & _MASK) | np.arange(len(gram), dtype=_U)
    w = width - GRAM + 1
    rows = np.r_[key, np.full(-len(key) % w, ~_U(0))].reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    at = (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & ~_MASK).astype(np.int64)
    inside = np.ones(len(x) + 1, np.int8)
    for e in ends:  # windows that would cross the end of a text
        inside[max(0, e - width + 1) : e] = 0
    p = np.flatnonzero(inside[:n])
    a = at[p]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]) if len(a) else none
    last = np.r_[cut[1:], len(p)] - 1 if len(a) else none
    return a[cut], gram[a[cut]], p[cut], p[last]


def tiles(rows: list[int], texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row, shift): texts laid end to end up to TILE bytes; a longer text is cut so that each window lies in one tile."""
    held, ids, shifts, n = [], [], [], 0

    def laid():
        ends = np.cumsum([len(h) for h in held])
        return np.frombuffer(b"".join(held), np.uint8), ends, np.array(ids, np.int64), np.array(shifts, np.int64)

    for row, text in zip(rows, texts, strict=True):
        for s in range(0, max(1, len(text) - width + 1), TILE - width + 1):
            part = text[s : s + TILE]
            if n + len(part) > TILE and held:
                yield laid()
                held, ids, shifts, n = [], [], [], 0
            held.append(part)
            ids.append(row)
            shifts.append(s)
            n += len(part)
    if held:
        yield laid()


def _cuts(key: np.ndarray) -> list[tuple[int, int]]:
    """Where each stretch of equal keys starts and ends."""
    if not len(key):
        return []
    at = np.flatnonzero(key[1:] != key[:-1]) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(key)], strict=True))


def _blobs(part: np.ndarray, kind: int, records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    for s, e in _cuts(part):
        yield int(part[s]), kind, records[s:e].tobytes()


def _batches(blobs: Iterator[tuple[int, int, bytes]], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def made():
        parts, kinds, blob = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])

    for b in blobs:
        held.append(b)
        n += len(b[2])
        if n >= most:
            yield made()
            held, n = [], 0
    if held:
        yield made()


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    """The blobs of each part by kind, one part after the other; rows come sorted by part."""
    part, kinds = None, {}
    for b in batches:
        for p, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if p != part:
                if kinds:
                    yield kinds
                part, kinds = p, {}
            kinds.setdefault(k, []).append(x)
    if kinds:
        yield kinds


def _dealt(sent: DataFrame) -> DataFrame:
    return sent.repartition("part").sortWithinPartitions("part")


def _packed(at: np.ndarray, first: np.ndarray, last: np.ndarray, hot) -> np.ndarray:
    """An anchor's place, how far before it its first window starts, how many windows it has, and if its gram is hot."""
    return at << 20 | (at - first) << 12 | (last - first) << 1 | hot


def _find_anchors(texts: DataFrame, parts: int, width: int) -> DataFrame:
    """(row, anchor) of each anchor whose gram occurs more than once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, found = Roller(), []
        for b in batches:
            for x, ends, rows, shifts in tiles(b.column("row").to_pylist(), b.column("text").to_pylist(), width):
                at, gram, first, last = anchors(x, ends, roll, width)
                of = np.searchsorted(ends, at, "right")
                base = (np.r_[0, ends[:-1]] - shifts)[of]
                r = np.zeros(len(at), _ANCHOR)
                r["gram"], r["row"], r["n"] = gram, rows[of], 1
                r["at"] = _packed(at - base, first - base, last - base, 0)
                found.append(r)
        if not found:
            return
        r = np.concatenate(found)
        r = r[np.argsort(r["gram"], kind="stable")]
        cut = np.flatnonzero(np.r_[True, r["gram"][1:] != r["gram"][:-1]]) if len(r) else np.zeros(0, np.int64)
        size = np.diff(np.r_[cut, len(r)])
        many = np.repeat(size > HOT_TASK, size)
        marks = r[cut[size > HOT_TASK]]  # one record tells the others that the gram is hot
        marks["row"], marks["n"] = -1, size[size > HOT_TASK]
        own = r[many]
        own["at"] |= 1
        r = np.concatenate([r[~many], marks])
        yield from _batches(_blobs((r["gram"] % _U(parts)).astype(np.int64), _SUFFIX, r))
        yield from _batches(_blobs((mix(own["row"].astype(_U)) % _U(parts)).astype(np.int64), _DONE, own))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _by_part(batches):
            r = np.frombuffer(b"".join(kinds.get(_SUFFIX, [])), _ANCHOR)
            _, group = np.unique(r["gram"], return_inverse=True)
            total = np.bincount(group, r["n"])[group] if len(r) else np.zeros(0)
            marked = np.bincount(group, r["n"] > HOT_TASK)[group] > 0 if len(r) else np.zeros(0, bool)
            hot = (total > HOT) | marked
            keep = (total > 1) & (r["row"] >= 0)
            done = np.frombuffer(b"".join(kinds.get(_DONE, [])), _ANCHOR)
            row = np.concatenate([r["row"][keep], done["row"]])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate([r["at"][keep] | hot[keep], done["at"]]))], ["row", "anchor"])

    sent = texts.select("row", "text").mapInArrow(scan, "part long, kind int, blob binary")
    return _dealt(sent).mapInArrow(meet, "row long, anchor long")


def front_coded(doc: np.ndarray, row: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, windows: np.ndarray, span: np.ndarray) -> bytes:
    """A sorted run: places, reach to the left and number of windows, then each suffix as the length shared with the one before and its rest."""
    n, width = right.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        differ = right[1:] != right[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    place = np.zeros(n, _PLACE)
    place["doc"], place["row"], place["at"] = doc, row, at
    length = windows + width - span  # bytes of the suffix that its windows need
    shared = np.minimum(shared, length)
    column = np.arange(width)
    rest = right[(column >= shared[:, None]) & (column < length[:, None])]
    lefts = left[np.arange(left.shape[1]) < span[:, None]]
    sizes = np.stack([shared, length, span, windows], axis=1).astype(np.uint8)
    return np.int64(n).tobytes() + place.tobytes() + sizes.tobytes() + rest.tobytes() + lefts.tobytes()


def decoded(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Places, sizes (shared, length, span, windows), suffixes (zeros after their length) and left bytes, nearest first."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    place = np.frombuffer(blob, _PLACE, n, 8)
    at = 8 + n * _PLACE.itemsize
    sizes = np.frombuffer(blob, np.uint8, 4 * n, at).reshape(n, 4)
    at += 4 * n
    right, left, before = [], [], b""
    for shared, length in sizes[:, :2].tolist():
        rest = length - shared
        before = (before[:shared] + blob[at : at + rest]).ljust(width, b"\0")
        at += rest
        right.append(before)
    for span in sizes[:, 2].tolist():
        left.append(blob[at : at + span].ljust(width, b"\0"))
        at += span
    return place, sizes, right, left


def merge_runs(runs: list[list[bytes]], prefixes: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs; prefixes[k][i] is what runs[k][i] shares with the one before it.

    Returns run, place in the run, and length shared with the one put out before. Each loser in the
    tree keeps what it shares with the last winner; where two such lengths differ the longer is the
    smaller string, and only where they are equal are bytes compared, from there on.
    """
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    place, known = [0] * size, [0] * size
    tree = [0] * size
    alive = [bool(i < k and runs[i]) for i in range(size)]

    def beats(a: int, b: int) -> bool:
        """If a's head goes before b's; the loser learns what it shares with the winner."""
        if not alive[b]:
            return True
        if not alive[a]:
            return False
        x, y = known[a], known[b]
        if x != y:
            return x > y
        s, t = runs[a][place[a]], runs[b][place[b]]
        gap = int.from_bytes(s[x:]) ^ int.from_bytes(t[x:])
        if not gap:
            known[b if a < b else a] = len(s)
            return a < b
        first = len(s) - (gap.bit_length() + 7) // 8
        won = s[first] < t[first]
        known[b if won else a] = first
        return won

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        a, b = (a, b) if beats(a, b) else (b, a)
        tree[node] = b
        return a

    winner = play(1) if size > 1 else 0
    of, at, lcp = [], [], []
    while alive[winner]:
        of.append(winner)
        at.append(place[winner])
        lcp.append(known[winner])
        place[winner] += 1
        if place[winner] < len(runs[winner]):
            known[winner] = prefixes[winner][place[winner]]
        else:
            alive[winner] = False
        node = (size + winner) >> 1
        while node:
            other = tree[node]
            if not beats(winner, other):
                tree[node], winner = winner, other
            node >>= 1
    return of, at, lcp


def _repeats(place: np.ndarray, sizes: np.ndarray, lcp: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Bytes covered by repeated windows, for suffixes in merged order: spans (row, start, end)."""
    n = len(place)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((place["at"], place["row"], place["doc"]))] = np.arange(n)
    by_left = np.argsort(left.view(f"V{left.shape[1]}").ravel(), kind="stable")
    lefts = left[by_left]
    differ = lefts[1:] != lefts[:-1]
    alike = np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])
    most, least = sizes[:, 2].astype(np.int64), sizes[:, 2].astype(np.int64) - sizes[:, 3]
    again = np.zeros((n, width - GRAM + 1), bool)
    for o in range(width - GRAM + 1):
        sel = np.flatnonzero((least <= o) & (o <= most))
        if len(sel) < 2:
            continue
        right_class = np.r_[0, np.cumsum(lcp[1:] < width - o)]
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.r_[0, np.cumsum(alike < o)]
        key = right_class[sel] * n + left_class[sel]
        order = np.lexsort((rank[sel], key))
        key = key[order]
        again[sel[order[1:]], o] = key[1:] == key[:-1]
    # a run of repeated windows of one anchor becomes one span; offset o starts o bytes before the anchor
    up = np.zeros((n, again.shape[1] + 2), np.int8)
    up[:, 1:-1] = again
    step = np.diff(up, axis=1)
    r, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    out = np.zeros(len(r), _SPAN)
    out["row"] = place["row"][r]
    out["start"], out["end"] = place["at"][r] - (after - 1), place["at"][r] - first + width
    return out


def _rows_of(spans: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(spans):
        yield pa.RecordBatch.from_arrays([pa.array(spans[c].copy()) for c in ("row", "start", "end")], ["row", "start", "end"])


def _spans(marked: DataFrame, parts: int, width: int) -> DataFrame:
    """(row, start, end) of repeated windows, from texts with the list of their anchors."""

    def runs(texts: list, docs: list, rows: list, lists: list) -> Iterator[tuple[int, int, bytes]]:
        x = np.frombuffer(b"".join([bytes(width), *(t + bytes(width) for t in texts)]), np.uint8)
        base = np.cumsum([width, *(len(t) + width for t in texts)])[:-1]
        of = np.repeat(np.arange(len(texts)), [len(a) for a in lists])
        packed = np.concatenate([np.array(a, np.int64) for a in lists])
        at, span, windows, hot = packed >> 20, packed >> 12 & 0xFF, packed >> 1 & 0x7FF, (packed & 1).astype(bool)
        view = np.lib.stride_tricks.sliding_window_view(x, width)
        doc, row = np.array(docs, _U)[of], np.array(rows, np.int64)[of]
        for s in range(0, len(at), 1 << 17):
            i = np.arange(s, min(len(at), s + (1 << 17)))[~hot[s : s + (1 << 17)]]
            here = base[of[i]] + at[i]
            right = view[here].copy()
            right[np.arange(width) >= (width - span[i] + windows[i])[:, None]] = 0
            grams = mix(right[:, :GRAM].copy().view("<u8") @ np.array([3, 5, 7, 11], _U) ^ mix(right[:, :8].copy().view("<u8").ravel()))
            part = (grams % _U(parts)).astype(np.int64)
            order = np.argsort(right.view(f"V{width}").ravel(), kind="stable")
            order = order[np.argsort(part[order], kind="stable")]
            i, here, right, part = i[order], here[order], right[order], part[order]
            left = view[here - width][:, ::-1][:, : width - GRAM]
            for a, b in _cuts(part):
                j = i[a:b]
                yield int(part[a]), _SUFFIX, front_coded(doc[j], row[j], at[j], left[a:b], right[a:b], windows[j], span[j])

    def windows_of(texts: list, docs: list, rows: list, lists: list, roll: Roller) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, bytes, hash) of the windows of hot grams."""
        for t, d, r, a in zip(texts, docs, rows, lists, strict=True):
            packed = np.array(a, np.int64)
            packed = packed[packed & 1 == 1]
            if not len(packed):
                continue
            first, count = (packed >> 20) - (packed >> 12 & 0xFF), (packed >> 1 & 0x7FF) + 1
            p = np.sort(np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum()))
            s = 0
            while s < len(p):  # a stretch of the text that holds the next windows
                at0 = int(p[s])
                e = min(s + HELD, int(np.searchsorted(p, at0 + TILE - width, "right")))
                x = np.frombuffer(t, np.uint8)[at0 : int(p[e - 1]) + width]
                w = np.zeros(e - s, _PLACE)
                w["doc"], w["row"], w["at"] = d, r, p[s:e]
                here = p[s:e] - at0
                yield w, np.lib.stride_tricks.sliding_window_view(x, width)[here], roll(x, width, _P1)[here]
                s = e

    def first_and_rest(w: np.ndarray, text: np.ndarray, key: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The windows without those that are byte for byte an earlier one of the same hash, and the latter's places."""
        order = np.lexsort((w["at"], w["row"], w["doc"], key))
        w, text, key = w[order], text[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(w) else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = ~new & (text == text[head]).all(axis=1)
        return (w[~again], text[~again], key[~again]), w[again]

    def window_runs(w: np.ndarray, text: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        part = (key % _U(parts)).astype(np.int64)
        order = np.argsort(text.view(f"V{width}").ravel(), kind="stable") if len(w) else np.zeros(0, np.int64)
        order = order[np.argsort(part[order], kind="stable")]
        w, text, part = w[order], text[order], part[order]
        for a, b in _cuts(part):
            none = np.zeros(b - a, np.int64)
            yield int(part[a]), _SUFFIX, front_coded(w["doc"][a:b], w["row"][a:b], w["at"][a:b], np.zeros((b - a, width - GRAM), np.uint8), text[a:b], none, none)

    def joined(w: np.ndarray) -> np.ndarray:
        """Windows as spans, neighbours in a row made one."""
        w = w[np.lexsort((w["at"], w["row"]))]
        new = np.r_[True, (w["row"][1:] != w["row"][:-1]) | (w["at"][1:] > w["at"][:-1] + 1)] if len(w) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        out = np.zeros(len(cut), _SPAN)
        out["row"], out["start"] = w["row"][cut], w["at"][cut]
        out["end"] = w["at"][np.r_[cut[1:], len(w)] - 1] + width if len(w) else 0
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, nothing = Roller(), (np.zeros(0, _PLACE), np.zeros((0, width), np.uint8), np.zeros(0, _U))
        firsts, held, count = nothing, [], 0

        def settle() -> Iterator[tuple[int, int, bytes]]:
            nonlocal firsts, held, count
            firsts, again = first_and_rest(*(np.concatenate(x) for x in zip(firsts, *held, strict=True)))
            held, count = [], 0
            spans = joined(again)
            yield from _blobs((mix(spans["row"].astype(_U)) % _U(parts)).astype(np.int64), _DONE, spans)
            if len(firsts[0]) > HELD:  # what is sent now is compared with later ones where the runs meet
                yield from window_runs(*firsts)
                firsts = nothing

        def all_blobs() -> Iterator[tuple[int, int, bytes]]:
            nonlocal count
            for b in batches:
                got = [b.column(c).to_pylist() for c in ("text", "doc", "row", "anchors")]
                got[1] = [d & (1 << 64) - 1 for d in got[1]]
                step = max(1, len(got[0]) * (1 << 23) // max(1, sum(map(len, got[0]))))
                for s in range(0, len(got[0]), step):
                    part = [g[s : s + step] for g in got]
                    yield from runs(*part)
                    for w in windows_of(*part, roll):
                        held.append(w)
                        count += len(w[0])
                        if count > HELD:
                            yield from settle()
            yield from settle()
            yield from window_runs(*firsts)

        yield from _batches(all_blobs())

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _by_part(batches):
            yield from _rows_of(np.frombuffer(b"".join(kinds.get(_DONE, [])), _SPAN))
            got = [decoded(b, width) for b in kinds.get(_SUFFIX, [])]
            if not got:
                continue
            of, at, lcp = merge_runs([g[2] for g in got], [g[1][:, 0].tolist() for g in got])
            start = np.cumsum([0, *(len(g[0]) for g in got)])
            order = start[np.array(of)] + np.array(at)
            place, sizes = (np.concatenate([g[k] for g in got])[order] for k in (0, 1))
            left = np.frombuffer(b"".join(x for g in got for x in g[3]), np.uint8).reshape(-1, width)[order]
            yield from _rows_of(_repeats(place, sizes, np.array(lcp), np.ascontiguousarray(left), width))

    sent = marked.select("row", "doc", "text", "anchors").mapInArrow(send, "part long, kind int, blob binary")
    return _dealt(sent).mapInArrow(receive, "row long, start long, end long")


def _stored(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> tuple[DataFrame, str, str]:
    """(row, doc_id, doc, text, n_bytes, digest), written once and bucketed by row; with the table's name and path."""
    spark = docs.sparkSession

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            cols = [pa.array(texts, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "text", "n_bytes", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    rows = rows.mapInArrow(digest, "doc_id long, text binary, n_bytes long, digest binary")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # ids as unsigned numbers in their order, null last
    rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))), F.lit(-1)))
    name, path = f"texts_{uuid.uuid4().hex}", new_path(spark, "texts")
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "row").saveAsTable(name)
    return spark.table(name), name, path


def _kept(text: bytes, spans: list) -> tuple[int, int, str]:
    """Bytes removed, maximal runs of them, and the SHA-256 of the rest."""
    sha, removed, runs, at = hashlib.sha256(), 0, 0, 0
    end = -1
    for x in sorted((s["start"], s["end"]) for s in spans):
        if x[0] > end or not runs:
            sha.update(text[at : x[0]])
            runs += 1
            removed += x[1] - x[0]
            end = x[1]
        elif x[1] > end:
            removed += x[1] - end
            end = x[1]
        at = end
    sha.update(text[at:])
    return removed, runs, sha.hexdigest()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte goes if a string of `width` bytes that covers it also starts earlier: in a row of smaller
    doc_id, or earlier in the same row; rows that share an id count in the order they are read, null
    ids come last. Null texts are empty; texts shorter than `width` keep all; other columns are
    ignored; an empty table gives an empty table.
    """
    if not GRAM < width <= 255:
        raise ValueError(f"width must be in {GRAM + 1}..255")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1024, PARTS * buckets)
    texts, name, path = _stored(docs, id_col, text_col, buckets)
    # ids as unsigned numbers compare as signed ones with the top bit turned
    order = F.struct(F.col("doc").bitwiseXOR(F.lit(-(1 << 63))), F.col("row"))
    first = texts.groupBy("digest").agg(F.min(order).getField("row").alias("row")).select("row")
    first = materialize(first, "first")
    leaders = texts.join(first.hint("shuffle_hash"), "row", "left_semi")
    found = _find_anchors(leaders, parts, width)
    lists = found.groupBy("row").agg(F.collect_list("anchor").alias("anchors"))
    marked = texts.join(lists.hint("shuffle_hash"), "row")
    spans = _spans(marked, parts, width).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = first.join(spans.hint("shuffle_hash"), "row", "left").select("row", "spans", F.lit(True).alias("leads"))
    both = texts.select("row", "doc_id", "text", "n_bytes").join(spans.hint("shuffle_hash"), "row", "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, leads in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "leads")), strict=True):
                if not leads and len(text) >= width:  # the same text stands in an earlier row
                    spans = [{"start": 0, "end": len(text)}]
                out.append(_kept(text, spans or []))
            removed, runs, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = materialize(both.mapInArrow(rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "deduped")
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path)
    discard(first)
    return out
