"""Batched numpy for what is not relational: solves by validity pattern, weighted and robust solves, filters, unwrapping."""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Patterns with fewer pixels than this in a batch are solved together, pixel by pixel.
RARE = 8
PIVOT_RATIO = 1e-6
IRLS_ROUNDS, IRLS_FLOOR_M, IRLS_STOP_M = 20, 1e-4, 1e-6


def round_away(x: np.ndarray) -> np.ndarray:
    """Nearest integer, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def full_rank_pinv(a: np.ndarray) -> np.ndarray | None:
    """Pseudo-inverse, or None if the least singular value is negligible."""
    if not a.size:
        return None
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    if s[-1] <= s[0] * max(a.shape) * np.finfo(float).eps:
        return None
    return (vt.T / s) @ u.T


def patterns(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a boolean matrix, and which of them each row is."""
    packed = np.packbits(mask, axis=1)
    key = np.ascontiguousarray(packed).view(f"V{packed.shape[1]}").ravel()
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return mask[first], of


def solve_gram(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Many small symmetric systems; NaN where one is not safely positive definite."""
    out = np.full(right.shape, np.nan)
    if not len(gram):
        return out
    # a pivot test by Cholesky, all systems at once, one column after the other
    n = gram.shape[1]
    low = np.zeros_like(gram)
    good = np.ones(len(gram), bool)
    for j in range(n):
        d = gram[:, j, j] - np.einsum("ik,ik->i", low[:, j, :j], low[:, j, :j])
        good &= d > 0
        root = np.sqrt(np.where(d > 0, d, 1.0))
        low[:, j, j] = root
        if j + 1 < n:
            low[:, j + 1 :, j] = (gram[:, j + 1 :, j] - np.einsum("irk,ik->ir", low[:, j + 1 :, :j], low[:, j, :j])) / root[:, None]
    pivots = np.einsum("ijj->ij", low)
    good &= pivots.min(axis=1) / np.maximum(pivots.max(axis=1), 1e-300) >= PIVOT_RATIO
    if good.any():
        out[good] = np.linalg.solve(gram[good], right[good][..., None])[..., 0]
    return out


def solvable(mask: np.ndarray, pairs, n_epochs: int, unknowns: int) -> np.ndarray:
    """Which rows of mask (rows, pairs) have pairs enough for the unknowns, and connect all epochs: least labels passed on along pairs, all rows at once."""
    label = np.repeat(np.arange(n_epochs, dtype=np.int32)[:, None], len(mask), axis=1)
    have = np.ascontiguousarray(mask.T)
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k].ref, pairs[k].sec))
    while True:
        before = label.copy()
        for k in order + order[::-1]:
            a, b = label[pairs[k].ref], label[pairs[k].sec]
            low = np.minimum(a, b)
            np.copyto(a, low, where=have[k])
            np.copyto(b, low, where=have[k])
        if (before == label).all():
            break
    return (label == 0).all(axis=0) & (mask.sum(axis=1) >= unknowns)


#: Pairs that span more epochs than this stand apart from the band, as updates of its inverse; with more of them than MOST_WIDE, or where the others do not connect all epochs, the normal equations are full.
WIDEST, MOST_WIDE = 16, 24


def wide_pairs(pairs) -> list[int]:
    return [k for k, p in enumerate(pairs) if p.sec - p.ref > WIDEST]


def banded_steps(b: np.ndarray, mask: np.ndarray, pairs, n_epochs: int) -> np.ndarray:
    """Increments by least squares over the pairs of each row that mask has (those of up to WIDEST epochs connect all epochs).

    As unknowns stand the epochs themselves, the first one 0: then the normal equations have as many
    diagonals as the widest pair spans, and one factorisation runs over the epochs for all rows at
    once. Wide pairs are left out of the band; each adds a right side of its own, and a small system
    of the wide pairs a row has (Woodbury's identity) puts them back.
    """
    wide = wide_pairs(pairs)
    width, rows = max((p.sec - p.ref for k, p in enumerate(pairs) if k not in wide), default=1), len(b)
    band, right = np.zeros((width + 1, n_epochs + width, rows)), np.zeros((n_epochs + width, 1 + len(wide), rows))
    for k, (p, w, x) in enumerate(zip(pairs, np.ascontiguousarray(mask.T), np.ascontiguousarray(np.where(mask, b, 0.0).T), strict=True)):
        right[p.sec, 0] += x
        right[p.ref, 0] -= x
        if k in wide:
            right[p.sec, 1 + wide.index(k)] = 1.0
            right[p.ref, 1 + wide.index(k)] = -1.0
            continue
        band[0, p.ref] += w
        band[0, p.sec] += w
        band[p.sec - p.ref, p.ref] -= w
    band[0, n_epochs:] = 1.0
    for e in range(1, n_epochs):
        share = band[1:, e] / band[0, e]
        for d in range(1, width + 1):
            for f in range(d, width + 1):
                band[f - d, e + d] -= share[d - 1] * band[f, e]
            right[e + d] -= share[d - 1] * right[e]
    out = np.zeros((n_epochs + width, 1 + len(wide), rows))
    for e in range(n_epochs - 1, 0, -1):
        x = right[e].copy()
        for d in range(1, width + 1):
            x -= band[d, e] * out[e + d]
        out[e] = x / band[0, e]
    x = out[:n_epochs, 0]
    if wide:
        across = np.stack([out[pairs[k].sec] - out[pairs[k].ref] for k in wide], axis=1)  # (1 + wide, wide, rows)
        have = mask[:, wide].astype(float)
        small = np.eye(len(wide)) + have[:, :, None] * across[1:].transpose(2, 1, 0)
        y = np.linalg.solve(small, (have * across[0].T)[..., None])[..., 0]
        x = x - np.einsum("ewr,rw->er", out[:n_epochs, 1:], y)
    return np.diff(x, axis=0).T


def ols(b: np.ndarray, design: np.ndarray, pairs, n_epochs: int, pinv: np.ndarray) -> np.ndarray:
    """Unknowns of each row of b (NaN: no data), by the pseudo-inverse of the pairs that it has; rows of rare patterns together."""
    mask = np.isfinite(b)
    out = np.full((len(b), design.shape[1]), np.nan)
    whole = mask.all(axis=1)
    out[whole] = b[whole] @ pinv.T
    rest = np.flatnonzero(~whole)
    if not len(rest):
        return out
    kinds, of = patterns(mask[rest])
    good = solvable(kinds, pairs, n_epochs, design.shape[1])
    count = np.bincount(of)
    for k in np.flatnonzero(good & (count >= RARE)):
        rows, m = rest[of == k], kinds[k]
        p = full_rank_pinv(design[m])
        if p is not None:
            out[rows] = b[np.ix_(rows, np.flatnonzero(m))] @ p.T
    rare = rest[(good & (count < RARE))[of]]
    wide = wide_pairs(pairs)
    if len(rare) and design.shape[1] == n_epochs - 1 and len(wide) <= MOST_WIDE:
        held = np.ones(len(rare), bool)
        if wide:
            near = np.ones(len(pairs), bool)
            near[wide] = False
            kinds, of = patterns(mask[rare] & near)
            held = solvable(kinds, pairs, n_epochs, 0)[of]
        for s in range(0, int(held.sum()), 4096):
            part = rare[held][s : s + 4096]
            out[part] = banded_steps(b[part], mask[part], pairs, n_epochs)
        rare = rare[~held]
    if len(rare):
        out[rare] = weighted(b[rare], np.where(mask[rare], 1.0, 0.0), design)
    return out


def weighted(b: np.ndarray, w: np.ndarray, design: np.ndarray) -> np.ndarray:
    """Weighted least squares of each row by normal equations; weight 0 leaves a pair out."""
    u = design.shape[1]
    outer = (design[:, :, None] * design[:, None, :]).reshape(len(design), u * u)
    out = np.empty((len(b), u))
    clean = np.where(w > 0, b, 0.0)
    step = max(1, (1 << 22) // (u * u))
    for s in range(0, len(b), step):
        part = slice(s, s + step)
        out[part] = solve_gram((w[part] @ outer).reshape(-1, u, u), (w[part] * clean[part]) @ design)
    return out


def weighted_checked(b: np.ndarray, w: np.ndarray, design: np.ndarray, pairs, n_epochs: int) -> np.ndarray:
    """weighted(), for rows whose valid pairs still connect all epochs."""
    mask = np.isfinite(b) & np.isfinite(w) & (w > 0)
    kinds, of = patterns(mask)
    good = solvable(kinds, pairs, n_epochs, design.shape[1])[of]
    out = np.full((len(b), design.shape[1]), np.nan)
    out[good] = weighted(b[good], np.where(mask[good], w[good], 0.0), design)
    return out


def robust(b: np.ndarray, w: np.ndarray, design: np.ndarray, pairs, n_epochs: int, rounds: int = IRLS_ROUNDS, floor: float = IRLS_FLOOR_M, stop: float = IRLS_STOP_M) -> np.ndarray:
    """Least absolute residuals by reweighting; a solve that fails leaves the last good answer."""
    x = weighted_checked(b, w, design, pairs, n_epochs)
    mask = np.isfinite(b) & np.isfinite(w) & (w > 0)
    live = np.flatnonzero(np.isfinite(x).all(axis=1))
    for _ in range(rounds):
        if not len(live):
            break
        residual = np.abs(np.where(mask[live], b[live], 0.0) - x[live] @ design.T)
        again = weighted(b[live], np.where(mask[live], w[live] / np.maximum(residual, floor), 0.0), design)
        ok = np.isfinite(again).all(axis=1)
        moved = np.abs(again - x[live]).max(axis=1)
        x[live[ok]] = again[ok]
        live = live[ok & (moved >= stop)]
    return x


def splitmix(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state and number of SplitMix64 generators (public-domain constants)."""
    with np.errstate(over="ignore"):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        z = state
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return state, z ^ (z >> np.uint64(31))


def bootstrap_slopes(d: np.ndarray, t: np.ndarray, seeds: np.ndarray, resamples: int) -> np.ndarray:
    """Standard deviation of the slopes of resampled epochs, for each row of d; NaN if fewer than two resamples have a slope."""
    n = len(t)
    total = np.zeros(len(d))
    square, count = np.zeros(len(d)), np.zeros(len(d))
    center = np.nan
    state = seeds.copy()
    spread = ((t - t.mean()) ** 2).sum()
    rows = np.arange(len(d))[:, None]
    slopes = []
    for _ in range(resamples):
        pick = np.empty((len(d), n), np.int64)
        for k in range(n):
            state, z = splitmix(state)
            pick[:, k] = (z % np.uint64(n)).astype(np.int64)
        tt, dd = t[pick], d[rows, pick]
        tc = tt - tt.mean(axis=1, keepdims=True)
        sxx = (tc * tc).sum(axis=1)
        fine = sxx > np.finfo(float).eps * max(spread, 1.0)
        with np.errstate(all="ignore"):
            slopes.append(np.where(fine, (tc * dd).sum(axis=1) / sxx, np.nan))
    s = np.array(slopes)
    count = np.isfinite(s).sum(axis=0)
    with np.errstate(all="ignore"):
        center = np.nansum(s, axis=0) / count
        square = np.nansum((s - center) ** 2, axis=0)
        total = np.sqrt(square / (count - 1))
    return np.where(count >= 2, total, np.nan)


def pixel_seeds(row: np.ndarray, col: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.uint64(seed) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (col.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def high_pass_matrix(t: np.ndarray, window: int) -> np.ndarray:
    """hp = d @ matrix.T: each epoch less a line fitted to the epochs around it (as many on either side; all if the window covers them)."""
    n = len(t)
    out = np.eye(n)
    for e in range(n):
        k = min(window // 2, e, n - 1 - e)
        lo, hi = (0, n) if window >= n else (e - k, e + k + 1)
        x = t[lo:hi]
        c = x - x.mean()
        sxx = (c * c).sum()
        out[e, lo:hi] -= 1 / len(x) + ((t[e] - x.mean()) * c / sxx if sxx > 0 else 0.0)
    return out


def gaussian(sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    i = np.arange(-r, r + 1)
    return np.exp(-(i**2) / (2 * sigma * sigma))


def _convolve(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    n = x.shape[axis]
    out = np.zeros_like(x)
    for k, w in enumerate(kernel):
        s = k - r
        if abs(s) >= n:
            continue
        to = [slice(None)] * 2
        of = [slice(None)] * 2
        to[axis] = slice(max(0, -s), n - max(0, s))
        of[axis] = slice(max(0, s), n - max(0, -s))
        out[tuple(to)] += w * x[tuple(of)]
    return out


def low_pass(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean of the valid neighbours; NaN stays NaN."""
    k = gaussian(sigma)
    ok = np.isfinite(grid)
    total = _convolve(_convolve(np.where(ok, grid, 0.0), k, 0), k, 1)
    weight = _convolve(_convolve(ok.astype(float), k, 0), k, 1)
    with np.errstate(all="ignore"):
        return np.where(ok & (weight > 1e-9), total / weight, np.nan)


def wrap_diff(d):
    return d - 2 * np.pi * np.ceil((d - np.pi) / (2 * np.pi))


def unwrap(wrapped: np.ndarray, quality: np.ndarray | None = None, least: float | None = None) -> np.ndarray:
    """unwrap_islands() from the grid's centre, or from the best pixel where there is a quality map: the phases alone."""
    return unwrap_islands(wrapped, quality, least, (wrapped.shape[0] // 2, wrapped.shape[1] // 2))[0]


def unwrap_islands(wrapped: np.ndarray, quality: np.ndarray | None = None, least: float | None = None, centre: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flood fill from the best pixel outwards, best neighbours first (ties by row, then column): phases, and the island (from 0; -1: none) of each pixel.

    Starts at `centre` (or, with a quality map, at the best pixel); a pixel that is not
    reached starts an island of its own. Not finite, or of less than the least quality: not unwrapped.
    """
    rows, cols = wrapped.shape
    ok = np.isfinite(wrapped)
    if quality is not None and least is not None:
        ok &= np.isfinite(quality) & (quality >= least)
    rank = np.zeros(wrapped.shape) if quality is None else np.where(np.isfinite(quality), quality, -np.inf)
    out, island = np.full(wrapped.shape, np.nan), np.full(wrapped.size, -1)
    flat_ok, flat, rk, res = ok.ravel().tolist(), wrapped.ravel().tolist(), rank.ravel().tolist(), [None] * wrapped.size
    seeds = sorted((i for i, v in enumerate(flat_ok) if v), key=lambda i: (-rk[i], i))
    if quality is None and centre is not None and flat_ok[centre[0] * cols + centre[1]]:
        seeds.insert(0, centre[0] * cols + centre[1])
    two_pi, pi, ceil, number = 2 * np.pi, np.pi, math.ceil, -1
    for seed in seeds:
        if res[seed] is not None:
            continue
        number += 1
        res[seed] = flat[seed]
        heap, reached = [(-rk[seed], seed)], [seed]
        while heap:
            _, i = heapq.heappop(heap)
            r, c = divmod(i, cols)
            for j, there in ((i - cols, r > 0), (i - 1, c > 0), (i + 1, c < cols - 1), (i + cols, r < rows - 1)):
                if there and flat_ok[j] and res[j] is None:
                    d = flat[j] - res[i]
                    res[j] = res[i] + d - two_pi * ceil((d - pi) / two_pi)
                    reached.append(j)
                    heapq.heappush(heap, (-rk[j], j))
        island[reached] = number
    for i, v in enumerate(res):
        if v is not None:
            out.flat[i] = v
    return out, island.reshape(wrapped.shape)


_STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def _shifted(x: np.ndarray, k: int, fill) -> np.ndarray:
    """What each pixel's neighbour in direction k has; `fill` beyond the edge."""
    dr, dc = _STEPS[k]
    out = np.full_like(x, fill)
    rows, cols = x.shape
    out[max(0, -dr) : rows - max(0, dr), max(0, -dc) : cols - max(0, dc)] = x[max(0, dr) : rows + min(0, dr), max(0, dc) : cols + min(0, dc)]
    return out


def _to_sink(cap: list[np.ndarray], sink: np.ndarray, far: int) -> np.ndarray:
    """Steps from each pixel to one with room to the sink, over edges with room; `far` where there is no way."""
    h = np.where(sink > 0, 1, far)
    while True:
        best = h
        for k in range(4):
            best = np.where(cap[k] > 0, np.minimum(best, _shifted(h, k, far) + 1), best)
        best = np.minimum(best, far)
        if (best == h).all():
            return h
        h = best


def source_side(cap: list[np.ndarray], source: np.ndarray, sink: np.ndarray) -> np.ndarray:
    """Pixels on the source's side of a minimum cut of a grid: room to each of the four neighbours, from the source, and to the sink, in whole numbers.

    Push and relabel, all pixels at once, one direction after the other.
    """
    cap, excess, sink = [c.copy() for c in cap], source.copy(), sink.copy()
    far = source.size + 2
    h, n = _to_sink(cap, sink, far), 0
    while ((excess > 0) & (h < far)).any():
        out = np.where(h < far, np.minimum(excess, sink), 0)
        excess -= out
        sink -= out
        for k in range(4):
            back = (k + 2) % 4
            out = np.where((excess > 0) & (h < far) & (h == _shifted(h, k, far) + 1), np.minimum(excess, cap[k]), 0)
            into = _shifted(out, back, 0)
            excess += into - out
            cap[k] -= out
            cap[back] += into
        n += 1
        if n % 16 == 0:
            h = _to_sink(cap, sink, far)
            continue
        low = np.where(sink > 0, 1, far)
        for k in range(4):
            low = np.where(cap[k] > 0, np.minimum(low, _shifted(h, k, far) + 1), low)
        h = np.where((excess > 0) & (h < far), np.maximum(h, np.minimum(low, far)), h)
    return _to_sink(cap, sink, far) >= far


def cheapest_turns(wrapped: np.ndarray, turns: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Whole turns of least cost: each pair of neighbours pays its lesser cost for every cycle by which it differs from the wrapped difference.

    This is the minimum-cost flow of the residues, in its dual form: from the turns given, sets of pixels are
    raised by one turn, each the best set there is (a minimum cut), until none lowers the cost; for this cost
    that is the least of all. turns is an integer grid, only where wrapped is finite; cost is a whole number, 1 at least.
    """
    ok = np.isfinite(wrapped)
    w = np.where(ok, wrapped, 0.0)
    t = np.where(ok, turns, 0).astype(np.int64)
    price, asked = [], []
    for k in range(2):
        both = ok & _shifted(ok, k, False)
        price.append(np.where(both, np.minimum(cost, _shifted(cost, k, 1)), 0).astype(np.int64))
        d = _shifted(w, k, 0.0) - w
        asked.append(-np.ceil((d - np.pi) / (2 * np.pi)).astype(np.int64))

    def total(t: np.ndarray) -> int:
        return int(sum((price[k] * np.abs(_shifted(t, k, 0) - t - asked[k])).sum() for k in range(2)))

    now = total(t)
    while now:
        push, cap = np.zeros(w.shape, np.int64), [np.zeros(w.shape, np.int64) for _ in range(4)]
        for k in range(2):
            d = _shifted(t, k, 0) - t - asked[k]
            level = np.where(d == 0, price[k], 0)
            cap[k] += level
            cap[k + 2] += _shifted(level, k + 2, 0)
            gain = price[k] * np.sign(d)  # of raising this pixel, and the loss of raising the neighbour
            push += gain - _shifted(gain, k + 2, 0)
        raised = t + source_side(cap, np.maximum(push, 0), np.maximum(-push, 0))
        better = total(raised)
        if better >= now:
            break
        t, now = raised, better
    return np.where(ok, t, 0)


def least_norm(loops: np.ndarray, active: np.ndarray, right: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least-squares solutions of least norm of loops[active[i]] x = right[i][active[i]], for all rows i at once, each with loops of its own.

    Conjugate gradients on the normal equations from 0 stay in the loops' row space, so they end at the
    least norm whatever the rank; a step is two products of whole matrices. Rows that have converged rest.
    """
    out = np.zeros((len(right), loops.shape[1]))
    at = np.arange(len(right))
    m = active.astype(float)
    r = right * m
    s = r @ loops
    p, gamma = s.copy(), (s * s).sum(axis=1)
    first = gamma.copy()
    for _ in range(rounds):
        go = gamma > 1e-26 * np.maximum(first, 1e-300)
        if not go.all():
            at, m, r, s, p, gamma, first = at[go], m[go], r[go], s[go], p[go], gamma[go], first[go]
        if not len(at):
            break
        q = (p @ loops.T) * m
        alpha = gamma / (q * q).sum(axis=1)
        out[at] += alpha[:, None] * p
        r -= alpha[:, None] * q
        s = r @ loops
        gamma, before = (s * s).sum(axis=1), gamma
        p = s + (gamma / before)[:, None] * p
    return out


def correct_closure(phase: np.ndarray, loops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-cycle errors that the closure of triangles betrays: corrected phases, and rows corrected / found but left.

    Loops with a missing pair are left out. Corrections are the rounded least-norm solution (halves, to a millionth, away from zero), applied
    only where they leave less misclosure. Frequent patterns of missing pairs share an inverse, rare ones are solved together.
    """
    done, left = np.zeros(len(phase), bool), np.zeros(len(phase), bool)
    if not len(loops):
        return phase, done, left
    out = phase.copy()
    active = ~((~np.isfinite(phase)).astype(float) @ np.abs(loops).T > 0)
    misclosed = round_away(np.where(active, np.nan_to_num(phase) @ loops.T, 0.0) / (2 * np.pi))
    todo = np.flatnonzero(np.abs(misclosed).sum(axis=1) > 0)
    if not len(todo):
        return out, done, left
    kinds, of = patterns(active[todo])
    count = np.bincount(of)
    cycles = np.zeros((len(todo), phase.shape[1]))
    for k in np.flatnonzero(count >= RARE):
        m = kinds[k]
        cycles[of == k] = misclosed[todo[of == k]][:, m] @ np.linalg.pinv(loops[m]).T
    rare = np.flatnonzero((count < RARE)[of])
    cycles[rare] = least_norm(loops, active[todo[rare]], misclosed[todo[rare]])
    cycles = round_away(np.where(np.abs(np.abs(cycles - np.trunc(cycles)) - 0.5) < 1e-6, np.trunc(cycles) + 0.5 * np.sign(cycles), cycles))
    was = misclosed[todo]
    now = np.where(active[todo], was - cycles @ loops.T, 0.0)
    better = np.abs(now).sum(axis=1) < np.abs(was).sum(axis=1)
    out[todo[better]] -= 2 * np.pi * cycles[better]
    done[todo[better]], left[todo[~better]] = True, True
    return out, done, left
