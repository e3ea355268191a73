"""Numpy in, numpy out: the operators for callers whose scene fits their own memory."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fringeflow.errors import DimensionMismatch
from fringeflow.functions.phase import WAVELENGTH_M
from fringeflow.operators import decompose as D
from fringeflow.operators import features as FE
from fringeflow.operators import filters, inversion, ps
from fringeflow.operators.cube import Meta, Pair, Series, Stack, every
from fringeflow.plans import pipeline
from fringeflow.sources.isce import IsceConfig

_ANY = date(2000, 1, 1)


def pixels(spark: SparkSession, **cubes: np.ndarray) -> DataFrame:
    """row, col and an array (of a cube, layers first) or a number (of a map) for each name; NaN as NULL."""
    shapes = {c.shape[-2:] for c in cubes.values()}
    if len(shapes) != 1:
        raise DimensionMismatch(f"grids of different sizes: {sorted(shapes)}")
    rows, cols = shapes.pop()
    r, c = np.divmod(np.arange(rows * cols), cols)
    import pyarrow as pa

    from fringeflow.operators.cube import lists, numbers

    columns = {"row": pa.array(r, pa.int32()), "col": pa.array(c, pa.int32())}
    for name, x in cubes.items():
        x = np.where(np.isfinite(x), np.asarray(x, float), np.nan)
        columns[name] = numbers(x.ravel()) if x.ndim == 2 else lists(x.reshape(len(x), -1).T)
    return spark.createDataFrame(pa.table(columns))


def grid(df: DataFrame, value: str, shape: tuple[int, int], layers: int | None = None) -> np.ndarray:
    out = np.full(shape if layers is None else (layers, *shape), np.nan)
    for r in df.select("row", "col", value).toLocalIterator():
        if r[2] is not None:
            out[..., r[0], r[1]] = r[2] if layers is None else [np.nan if x is None else x for x in r[2]]
    return out


def _stack(spark: SparkSession, phase: np.ndarray, pairs, epochs, coh: np.ndarray | None = None, wavelength_m: float = WAVELENGTH_M, incidence_deg: float = 39.0) -> Stack:
    made = tuple(p if isinstance(p, Pair) else Pair(*p) for p in pairs)
    if len(made) != len(phase):
        raise DimensionMismatch(f"{len(phase)} layers for {len(made)} pairs")
    cubes = {"phase": phase} if coh is None else {"phase": phase, "coh": coh}
    return Stack(pixels(spark, **cubes), tuple(epochs), made, phase.shape[1:], Meta(wavelength_m=wavelength_m, incidence_deg=incidence_deg))


def _series(spark: SparkSession, disp: np.ndarray, epochs) -> Series:
    if len(disp) != len(epochs):
        raise DimensionMismatch(f"{len(disp)} layers for {len(epochs)} epochs")
    return Series(pixels(spark, disp=disp), tuple(epochs), disp.shape[1:])


def invert_sbas(spark: SparkSession, phase: np.ndarray, pairs, epochs, coh: np.ndarray | None = None, weights: str | None = None, dem_range_m: float | None = None, robust: bool = False, **meta) -> dict[str, np.ndarray]:
    """displacement (epochs, rows, cols) and, with dem_range_m, dem_error (rows, cols)."""
    s = inversion.invert(_stack(spark, phase, pairs, epochs, coh, **meta), weights, dem_range_m, robust)
    out = {"displacement": grid(s.px, "disp", s.shape, len(s.epochs))}
    if dem_range_m is not None:
        out["dem_error"] = grid(s.px, "dem_error_m", s.shape)
    return out


def estimate_velocity(spark: SparkSession, disp: np.ndarray, epochs) -> np.ndarray:
    return grid(inversion.velocity(_series(spark, disp, epochs)), "velocity", disp.shape[1:])


def estimate_velocity_uncertainty(spark: SparkSession, disp: np.ndarray, epochs) -> np.ndarray:
    return grid(inversion.velocity_uncertainty(_series(spark, disp, epochs)), "velocity_std", disp.shape[1:])


def amplitude_dispersion(spark: SparkSession, amplitude: np.ndarray) -> np.ndarray:
    from pyspark.sql import functions as F

    long = pixels(spark, a=amplitude).select("row", "col", F.posexplode("a").alias("epoch_idx", "amplitude"))
    return grid(ps.amplitude_dispersion(long, len(amplitude)), "amp_dispersion", amplitude.shape[1:])


def temporal_coherence(spark: SparkSession, phase: np.ndarray, disp: np.ndarray, pairs, epochs, **meta) -> np.ndarray:
    got = inversion.temporal_coherence(_stack(spark, phase, pairs, epochs, **meta), _series(spark, disp, epochs))
    return grid(got, "temporal_coherence", phase.shape[1:])


def sbas_from_isce(spark: SparkSession, folder: str, baselines: str | None = None, wavelength_m: float = WAVELENGTH_M, incidence_deg: float = 39.0) -> dict:
    got = pipeline.run_sbas_isce(spark, folder, files=IsceConfig(baselines=baselines, wavelength_m=wavelength_m, incidence_deg=incidence_deg))
    s = got.series
    return {"epochs": s.epochs, "displacement": grid(s.px, "disp", s.shape, len(s.epochs)), "velocity": grid(got.velocity, "velocity", s.shape), "temporal_coherence": grid(got.temporal_coherence, "temporal_coherence", s.shape)}


def decompose_asc_desc(spark: SparkSession, ascending: np.ndarray, descending: np.ndarray, asc: tuple[float, float], desc: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    got = D.decompose_asc_desc(pixels(spark, a=ascending, d=descending), "a", "d", asc, desc)
    return grid(got, "up", ascending.shape), grid(got, "east", ascending.shape)


def decompose_per_pixel(spark: SparkSession, values: list[np.ndarray], incidence: list[np.ndarray], heading: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names = {f"{k}{i}": x for k, xs in (("v", values), ("i", incidence), ("h", heading)) for i, x in enumerate(xs)}
    got = D.decompose_per_pixel(pixels(spark, **names), *([f"{k}{i}" for i in range(len(xs))] for k, xs in (("v", values), ("i", incidence), ("h", heading))))
    return grid(got, "up", values[0].shape), grid(got, "east", values[0].shape)


def extract_features(spark: SparkSession, disp: np.ndarray, epochs, config: FE.FeatureConfig | None = None) -> dict[str, np.ndarray]:
    config = config or FE.FeatureConfig()
    got = FE.extract(_series(spark, disp, epochs), config).persist()
    out = {name: grid(got, name, disp.shape[1:]) for name in FE.names(config)}
    got.unpersist()
    return out


def remove_ramp(spark: SparkSession, values: np.ndarray, model: str = "linear", mask: np.ndarray | None = None) -> np.ndarray:
    px = pixels(spark, v=values) if mask is None else pixels(spark, v=values, m=mask.astype(float)).selectExpr("row", "col", "v", "m = 1 AS m")
    return grid(filters.deramp_map(px, "v", values.shape, model, None if mask is None else "m"), "v", values.shape)


def correct_unwrap_errors(spark: SparkSession, phase: np.ndarray, pairs) -> tuple[np.ndarray, int, int]:
    """Corrected phases, pixels corrected, pixels with errors found and left."""
    epochs = every(_ANY, 1, 1 + max(p.sec if isinstance(p, Pair) else p[1] for p in pairs))
    fixed, flags = inversion.correct_closure(_stack(spark, phase, pairs, epochs))
    done, left = flags.selectExpr("count_if(corrected)", "count_if(detected)").first()
    return grid(fixed.px, "phase", phase.shape[1:], len(phase)), done, left
