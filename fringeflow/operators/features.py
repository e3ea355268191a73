"""A row of descriptors for each pixel's series."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import InversionError
from fringeflow.functions.phase import pixel_to_geo
from fringeflow.operators import kernels
from fringeflow.operators.cube import Series, map_pixels, matrix, numbers, years


@dataclass(frozen=True)
class FeatureConfig:
    acceleration: bool = True
    seasonal: bool = True
    min_valid: int = 5


def names(config: FeatureConfig, coherence: bool = False) -> list[str]:
    """Columns in their order; they depend on the settings only, never on the data."""
    return [
        "velocity", "velocity_std", *(["acceleration"] if config.acceleration else []), "linearity_r2", "residual_rms", "cumulative",
        *(["seasonal_amplitude", "seasonal_phase"] if config.seasonal else []), "max_step", *(["temporal_coherence"] if coherence else []),
    ]


def _design(t: np.ndarray, config: FeatureConfig) -> np.ndarray:
    cols = [np.ones_like(t), t, *([t * t] if config.acceleration else [])]
    if config.seasonal:
        cols += [np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)]
    return np.array(cols).T


#: Rows that are described at once.
_AT_ONCE = 2048


def describe(d: np.ndarray, t: np.ndarray, config: FeatureConfig) -> dict[str, np.ndarray]:
    """Features of each row of d, fitted to the epochs that it has; NaN with too few, or where they cannot tell the terms apart."""
    parts = [_described(d[s : s + _AT_ONCE], t, config) for s in range(0, max(1, len(d)), _AT_ONCE)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _described(d: np.ndarray, t: np.ndarray, config: FeatureConfig) -> dict[str, np.ndarray]:
    g = _design(t, config)
    m = g.shape[1]
    out = {k: np.full(len(d), np.nan) for k in names(config)}
    mask = np.isfinite(d)
    kinds, of = kernels.patterns(mask)
    count = kinds.sum(axis=1)
    u, s, vt = np.linalg.svd(g * kinds[:, :, None], full_matrices=False)  # an epoch that is not there is a row of zeros
    fit = (count >= max(config.min_valid, m)) & (s[:, -1] > s[:, 0] * np.maximum(count, m) * np.finfo(float).eps)
    rows = np.flatnonzero(fit[of])
    if not len(rows):
        return out
    of, ok, q = of[rows], mask[rows], count[of[rows]]
    y = np.where(ok, d[rows], 0.0)
    inverse = 1 / np.where(fit[:, None], s, 1.0)
    c = np.einsum("rkj,rk->rj", vt[of], inverse[of] * np.einsum("rek,re->rk", u[of], y))
    r = np.where(ok, y - c @ g.T, 0.0)
    ssr = (r * r).sum(axis=1)
    tot = (np.where(ok, y - (y.sum(axis=1) / q)[:, None], 0.0) ** 2).sum(axis=1)
    out["velocity"][rows] = c[:, 1]
    with np.errstate(all="ignore"):
        spare = np.where(q > m, q - m, np.nan)
        out["velocity_std"][rows] = np.sqrt(ssr / spare * ((vt[:, :, 1] * inverse) ** 2).sum(axis=1)[of])
    if config.acceleration:
        out["acceleration"][rows] = 2 * c[:, 2]
    if config.seasonal:
        out["seasonal_amplitude"][rows], out["seasonal_phase"][rows] = np.hypot(c[:, -2], c[:, -1]), np.arctan2(c[:, -1], c[:, -2])
    with np.errstate(all="ignore"):
        out["linearity_r2"][rows] = np.where(tot <= np.finfo(float).eps, 1.0, np.clip(1 - ssr / tot, 0, 1))
    out["residual_rms"][rows] = np.sqrt(ssr / q)
    at, n = np.arange(len(rows)), ok.shape[1]
    out["cumulative"][rows] = y[at, n - 1 - ok[:, ::-1].argmax(axis=1)] - y[at, ok.argmax(axis=1)]
    step, last = np.zeros(len(rows)), y[at, ok.argmax(axis=1)].copy()
    for e in range(n):
        np.maximum(step, np.abs(y[:, e] - last), out=step, where=ok[:, e])
        np.copyto(last, y[:, e], where=ok[:, e])
    out["max_step"][rows] = step
    return out


def extract(series: Series, config: FeatureConfig | None = None, coherence: DataFrame | None = None) -> DataFrame:
    """row, col and the columns of names(); coherence(row, col, temporal_coherence) adds its column."""
    config = config or FeatureConfig()
    t, n = years(series.epochs), len(series.epochs)
    m = _design(t, config).shape[1]
    if n < m:
        raise InversionError(f"{n} epochs are too few for {m} coefficients")
    cols = names(config)

    def kernel(disp):
        got = describe(matrix(disp, n), t, config)
        return [numbers(got[c]) for c in cols]

    out = map_pixels(series.px, ["disp"], kernel, {c: "double" for c in cols}, ["row", "col"])
    return out if coherence is None else out.join(coherence.select("row", "col", "temporal_coherence"), ["row", "col"], "left")


def to_table(features: DataFrame, columns: list[str], transform: tuple[float, float, float, float], mask: DataFrame | None = None) -> DataFrame:
    """x, y and the features of pixels that have all of them; mask(row, col, keep) restricts them to where keep is true."""
    rows = features.na.drop(subset=columns)
    if mask is not None:
        rows = rows.join(mask.where("keep").select("row", "col"), ["row", "col"], "left_semi")
    x, y = pixel_to_geo(F.col("row"), F.col("col"), transform)
    return rows.select("row", "col", x.alias("x"), y.alias("y"), *columns)


def write_csv(table: DataFrame, columns: list[str], path: str) -> None:
    """Header x, y, features; rows in row-major order, over as many files as Spark makes of the range."""
    table.orderBy("row", "col").select("x", "y", *columns).write.mode("overwrite").csv(path, header=True)
