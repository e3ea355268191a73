"""From pair phases to displacement series, velocities and their uncertainty."""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, InvalidNetwork, InversionError, MetadataError
from fringeflow.operators import kernels
from fringeflow.operators.cube import Series, Stack, as_stored, check_epochs, check_meta, check_pairs, lists, map_pixels, matrix, numbers, years
from fringeflow.operators.network import design_matrix, is_connected


def dem_error_column(pairs, range_m: float, incidence_deg: float) -> np.ndarray:
    """Metres along the line of sight for a metre of height error, for each pair."""
    if not (np.isfinite(range_m) and range_m > 0):
        raise MetadataError("slant range must be finite and positive")
    if not 0 < incidence_deg < 90:
        raise MetadataError("incidence must be in (0, 90) degrees")
    g = -np.array([p.perp_baseline_m for p in pairs]) / (range_m * np.sin(np.radians(incidence_deg)))
    if not g.any():
        raise MetadataError("all baselines are zero: a height error cannot be seen")
    return g


def invert(stack: Stack, weights: str | None = None, dem_range_m: float | None = None, robust: bool = False, candidates: DataFrame | None = None, keep_phase: bool = False) -> Series:
    """Displacement at each epoch from the pairs' phases, pixel by pixel, over the pairs that the pixel has.

    weights: None (each pair alike), `coherence` or `variance`; dem_range_m adds a height error (column
    dem_error_m); robust minimises absolute residuals; candidates (row, col) restricts the work to
    those pixels before anything is computed; keep_phase leaves the phases beside the series, so that its
    temporal coherence needs no join. A pixel whose pairs do not connect all epochs, or are
    fewer than the unknowns, is NULL throughout; else the first epoch is 0.
    """
    n = len(stack.epochs)
    if n < 2:
        raise InvalidNetwork("at least two epochs are needed")
    check_epochs(stack.epochs)
    check_pairs(stack.pairs, n)
    check_meta(stack.meta)
    if not is_connected(stack.pairs, n):
        raise InvalidNetwork("the network does not connect all epochs")
    if weights not in (None, "unit", "coherence", "variance"):
        raise MetadataError(f"unknown weighting {weights}")
    weigh = weights not in (None, "unit")
    if weigh and "coh" not in stack.px.columns:
        raise InversionError("weights need coherence")
    design = design_matrix(stack.pairs, n)
    scale = None
    if dem_range_m is not None:
        g = dem_error_column(stack.pairs, dem_range_m, stack.meta.incidence_deg)
        scale = float(np.linalg.norm(g))
        design = np.hstack([design, (g / scale)[:, None]])
    pinv = np.linalg.pinv(design) if not (weigh or robust) else None
    to_m, k, pairs = -stack.meta.wavelength_m / (4 * np.pi), len(stack.pairs), stack.pairs
    px = stack.px
    if candidates is not None:
        px = px.join(candidates.select("row", "col"), ["row", "col"], "left_semi")

    def kernel(phase, coh=None):
        b = matrix(phase, k) * to_m
        if pinv is not None:
            x = kernels.ols(b, design, pairs, n, pinv)
        else:
            w = np.ones_like(b)
            if coh is not None:
                g = np.clip(matrix(coh, k), 0.01, 0.99)
                w = g if weights == "coherence" else 2 * g * g / (1 - g * g)
            x = (kernels.robust if robust else kernels.weighted_checked)(b, w, design, pairs, n)
        steps = x[:, : n - 1]
        disp = np.hstack([np.where(np.isfinite(steps[:, :1]), 0.0, np.nan), np.cumsum(steps, axis=1)])
        return [lists(disp)] if scale is None else [lists(disp), numbers(x[:, -1] / scale)]

    out = {"disp": "array<double>"} | ({"dem_error_m": "double"} if scale is not None else {})
    px = map_pixels(px, ["phase", "coh"] if weigh else ["phase"], kernel, out, ["row", "col", *(["phase"] if keep_phase else [])])
    return Series(px, stack.epochs, stack.shape, stack.meta)


def _slope_weights(epochs: tuple[date, ...]) -> np.ndarray:
    t = years(epochs)
    c = t - t.mean()
    sxx = (c * c).sum()
    if len(t) < 2 or sxx <= 0:
        raise InversionError("at least two epochs at different dates are needed")
    return c / sxx


def velocity(series: Series) -> DataFrame:
    """row, col, velocity (metres a year): the slope over all epochs; NULL if any epoch is missing."""
    w, n = _slope_weights(series.epochs), len(series.epochs)

    def kernel(disp):
        with np.errstate(invalid="ignore"):
            v = as_stored(disp, n) @ w  # a number that is not finite leaves none
        return [numbers(np.where(np.isfinite(v), v, np.nan))]

    return map_pixels(series.px, ["disp"], kernel, {"velocity": "double"}, ["row", "col"])


def velocity_long(series: DataFrame, n_epochs: int) -> DataFrame:
    """The same from long rows (row, col, t_yr, disp_m), by built-in aggregates only."""
    return series.groupBy("row", "col").agg(F.when(F.count("disp_m") == n_epochs, F.regr_slope("disp_m", "t_yr")).alias("velocity"))


def velocity_uncertainty(series: Series) -> DataFrame:
    """row, col, velocity_std: the slope's standard error; at least three epochs; NULL if any epoch is missing."""
    n = len(series.epochs)
    if n < 3:
        raise InversionError("at least three epochs are needed")
    w, t = _slope_weights(series.epochs), years(series.epochs)
    c = t - t.mean()
    sxx = (c * c).sum()

    def kernel(disp):
        d = matrix(disp, n)
        r = d - d.mean(axis=1, keepdims=True) - np.outer(d @ w, c)
        return [numbers(np.sqrt((r * r).sum(axis=1) / (n - 2) / sxx))]

    return map_pixels(series.px, ["disp"], kernel, {"velocity_std": "double"}, ["row", "col"])


def velocity_bootstrap(series: Series, resamples: int = 200, seed: int = 42) -> DataFrame:
    """row, col, velocity_std from resampled epochs; the numbers drawn depend on seed, row and col alone."""
    n = len(series.epochs)
    if n < 3 or resamples < 2:
        raise InversionError("at least three epochs and two resamples are needed")
    t = years(series.epochs)

    def kernel(row, col, disp):
        d = matrix(disp, n)
        whole = np.isfinite(d).all(axis=1)
        out = np.full(len(d), np.nan)
        seeds = kernels.pixel_seeds(row.to_numpy(), col.to_numpy(), seed)
        out[whole] = kernels.bootstrap_slopes(d[whole], t, seeds[whole], resamples)
        return [numbers(out)]

    return map_pixels(series.px, ["row", "col", "disp"], kernel, {"velocity_std": "double"}, ["row", "col"])


def temporal_design(epochs: tuple[date, ...], order: int = 1, periods: tuple[float, ...] = (), steps: tuple[date, ...] = ()) -> tuple[np.ndarray, list[str]]:
    """Columns and names: offset, velocity, poly2.., cosine and sine of each period (years), a step at each date."""
    t = years(epochs)
    if order < 1:
        raise InversionError("order must be 1 or more")
    cols, names = [t**k for k in range(order + 1)], ["offset", "velocity", *(f"poly{k}" for k in range(2, order + 1))]
    for p in periods:
        if not (np.isfinite(p) and p > 0):
            raise InversionError(f"period {p} must be finite and positive")
        cols += [np.cos(2 * np.pi * t / p), np.sin(2 * np.pi * t / p)]
        names += [f"cos_{p:g}yr", f"sin_{p:g}yr"]
    for s in steps:
        if not epochs[0] < s <= epochs[-1]:
            raise InversionError(f"step {s} is outside the series")
        cols.append(np.array([float(e >= s) for e in epochs]))
        names.append(f"step_{s:%Y%m%d}")
    design = np.array(cols).T
    if len(epochs) < design.shape[1] + 1:
        raise InversionError(f"{len(epochs)} epochs are too few for {design.shape[1]} coefficients")
    return design, names


def fit_temporal_model(series: Series, order: int = 1, periods: tuple[float, ...] = (), steps: tuple[date, ...] = ()) -> tuple[DataFrame, list[str]]:
    """row, col, velocity, velocity_std, coefficients (an array named by the list returned); NULL if any epoch is missing."""
    design, names = temporal_design(series.epochs, order, periods, steps)
    pinv = kernels.full_rank_pinv(design)
    if pinv is None:
        raise InversionError("the model's terms cannot be told apart at these epochs")
    n, m = design.shape
    inverse = np.linalg.inv(design.T @ design)[1, 1]

    def kernel(disp):
        d = matrix(disp, n)
        c = d @ pinv.T
        r = d - c @ design.T
        return [numbers(c[:, 1]), numbers(np.sqrt((r * r).sum(axis=1) / (n - m) * inverse)), lists(c)]

    out = {"velocity": "double", "velocity_std": "double", "coefficients": "array<double>"}
    return map_pixels(series.px, ["disp"], kernel, out, ["row", "col"]), names


def temporal_coherence(stack: Stack, series: Series) -> DataFrame:
    """row, col, temporal_coherence: how well the series explains the pixel's valid pairs (1: exactly); NULL without any."""
    n, k = len(series.epochs), len(stack.pairs)
    ref, sec = (np.array([getattr(p, x) for p in stack.pairs]) for x in ("ref", "sec"))
    to_phase = -4 * np.pi / stack.meta.wavelength_m

    def kernel(phase, disp):
        f, d = matrix(phase, k), matrix(disp, n)
        r = f - to_phase * (d[:, sec] - d[:, ref])
        ok = np.isfinite(r)
        r = np.where(ok, r, 0.0)
        count = ok.sum(axis=1)
        with np.errstate(all="ignore"):
            return [numbers(np.hypot((np.cos(r) * ok).sum(axis=1), (np.sin(r) * ok).sum(axis=1)) / np.where(count > 0, count, np.nan))]

    both = series.px
    if "phase" not in both.columns:
        both = stack.px.select("row", "col", "phase").join(both.select("row", "col", "disp"), ["row", "col"])
    return map_pixels(both, ["phase", "disp"], kernel, {"temporal_coherence": "double"}, ["row", "col"])


def select_reference_pixel(coh: DataFrame, region: tuple[int, int, int, int] | None = None) -> tuple[int, int] | None:
    """The pixel of long rows (row, col, coh) with the most valid layers, then the highest mean (as a FLOAT), then the first; None without any."""
    from fringeflow.functions.phase import in_region, valid

    rows = coh if region is None else coh.where(in_region(F.col("row"), F.col("col"), region))
    g = valid(F.col("coh"))
    stats = rows.groupBy("row", "col").agg(F.count(g).alias("n"), F.avg(g).cast("float").alias("m")).where("n > 0")
    got = stats.orderBy(F.col("n").desc(), F.col("m").desc(), "row", "col").limit(1).collect()
    return (got[0]["row"], got[0]["col"]) if got else None


def reference_to_pixel(stack: Stack, row: int, col: int) -> tuple[Stack, int]:
    """Phases less those of one pixel, and how many pairs are lost because it has none there."""
    if not (0 <= row < stack.shape[0] and 0 <= col < stack.shape[1]):
        raise DimensionMismatch(f"pixel ({row}, {col}) is outside the grid")
    got = stack.px.where((F.col("row") == row) & (F.col("col") == col)).select("phase").limit(1).collect()
    k = len(stack.pairs)
    base = np.array([np.nan if x is None else x for x in got[0]["phase"]]) if got and got[0]["phase"] else np.full(k, np.nan)
    px = map_pixels(stack.px, ["phase"], lambda f: [lists(matrix(f, k) - base)], {"phase": "array<double>"})
    return stack.with_px(px), int(np.isnan(base).sum())


def correct_closure(stack: Stack) -> tuple[Stack, DataFrame]:
    """Phases without the whole-cycle errors that triangles betray; and row, col, corrected, detected for each pixel."""
    from fringeflow.operators.network import loop_matrix

    loops, k = loop_matrix(stack.pairs), len(stack.pairs)

    def kernel(phase):
        out, done, left = kernels.correct_closure(matrix(phase, k), loops)
        return [lists(out), pa.array(done), pa.array(left)]

    px = map_pixels(stack.px, ["phase"], kernel, {"phase": "array<double>", "corrected": "boolean", "detected": "boolean"})
    return stack.with_px(px.drop("corrected", "detected")), px.select("row", "col", "corrected", "detected")


def nonzero_closures(stack: Stack) -> DataFrame:
    """row, col, closures: triangles that do not close to within half a cycle; NULL if none has all its pairs."""
    from fringeflow.operators.network import loop_matrix

    loops, k = loop_matrix(stack.pairs), len(stack.pairs)

    def kernel(phase):
        f = matrix(phase, k)
        active = ~((~np.isfinite(f)).astype(float) @ np.abs(loops).T > 0)
        n = kernels.round_away(np.where(active, np.nan_to_num(f) @ loops.T, 0.0) / (2 * np.pi))
        return [numbers(np.where(active.any(axis=1), (n != 0).sum(axis=1), np.nan))]

    return map_pixels(stack.px, ["phase"], kernel, {"closures": "double"}, ["row", "col"])
