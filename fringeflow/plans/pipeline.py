"""The two whole runs: from wrapped interferograms, and from an ISCE folder; as DataFrames, written as GeoTIFF and CSV on demand."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, InversionError, MetadataError
from fringeflow.operators import filters, inversion, ps, unwrapping
from fringeflow.operators.cube import Series, Stack, to_long, to_pixels
from fringeflow.sources import geotiff, isce, manifest


@dataclass(frozen=True)
class Solver:
    weights: str | None = None
    dem_range_m: float | None = None
    robust: bool = False


@dataclass(frozen=True)
class SbasConfig:
    ps_threshold: float | None = None
    min_quality: float | None = None
    correct_closure: bool = True
    reference: tuple[int, int] | None = None
    reference_region: tuple[int, int, int, int] | None = None
    solver: Solver = Solver()
    deramp: str | None = None
    aps_sigma: float = 8.0
    aps_window: int = 5


@dataclass
class Products:
    series: Series
    velocity: DataFrame
    temporal_coherence: DataFrame
    velocity_std: DataFrame | None = None
    closures: DataFrame | None = None
    flags: DataFrame | None = None  # row, col, corrected, detected
    dem_error: DataFrame | None = None
    lost_pairs: int = 0


def should_apply_aps(n_epochs: int, window: int) -> bool:
    return n_epochs >= 3 and window > 1


def select_ps_from(spark: SparkSession, folder: str, threshold: float) -> DataFrame:
    amp, m, _ = manifest.read_amplitudes(spark, folder)
    got = ps.select_ps(ps.amplitude_dispersion(amp, len(m.epochs)), threshold)
    if got.isEmpty():
        raise InversionError(f"no pixel has an amplitude dispersion of {threshold} or less")
    return got


def _closure(stack: Stack, correct: bool) -> tuple[Stack, DataFrame | None, DataFrame]:
    flags = None
    if correct:
        stack, flags = inversion.correct_closure(stack)
    return stack, flags, inversion.nonzero_closures(stack)


def _reference(stack: Stack, pixel: tuple[int, int] | None, region, fallback: tuple[int, int] | None) -> tuple[Stack, int]:
    if pixel is None and "coh" in stack.px.columns:
        pixel = inversion.select_reference_pixel(to_long(stack.px, "pair_idx", "coh", "coh"), region)
    pixel = pixel or fallback
    return (stack, 0) if pixel is None else inversion.reference_to_pixel(stack, *pixel)


def _solved(stack: Stack, solver: Solver, candidates: DataFrame | None = None) -> Series:
    return inversion.invert(stack, solver.weights, solver.dem_range_m, solver.robust, candidates, keep_phase=True)


def _used_again(px: DataFrame) -> DataFrame:
    """Kept where it is computed (in memory, else on disk): several products are made of it."""
    return px.persist(StorageLevel.MEMORY_AND_DISK)


def run_sbas(spark: SparkSession, folder: str, config: SbasConfig | None = None) -> Products:
    """Unwrap, correct, reference, invert, take out atmosphere and ramps, fit velocities.

    Temporal coherence is that of the series as inverted. Without coherence and without a stated pixel
    the phases stay unreferenced.
    """
    config = config or SbasConfig()
    layers, m, shape = manifest.read_interferograms(spark, folder)
    coh = manifest.read_coherence(spark, folder)
    if coh is not None and coh[1] != shape:
        raise DimensionMismatch(f"coherence {coh[1]} is not of the size of the interferograms {shape}")
    candidates = select_ps_from(spark, folder, config.ps_threshold) if config.ps_threshold is not None else None
    if coh is not None:
        layers = layers.join(coh[0], ["row", "col", "pair_idx"], "left")
    elif config.min_quality is not None:
        raise InversionError("a least quality needs coherence")
    phases = unwrapping.unwrap_stack(layers, shape, "coh" if coh is not None else None, config.min_quality)
    values = {"phase": "phase"}
    if coh is not None:
        phases = phases.withColumn("coh", F.lit(None).cast("double")).unionByName(coh[0].withColumn("phase", F.lit(None).cast("double")), allowMissingColumns=True)
        values["coh"] = "coh"
    stack = Stack(_used_again(to_pixels(phases, "pair_idx", len(m.pairs), **values)), m.epochs, m.pairs, shape, m.meta)
    stack, flags, closures = _closure(stack, config.correct_closure)
    stack, lost = _reference(stack, config.reference, config.reference_region, None)
    series = _solved(stack, config.solver, candidates)
    series = series.with_px(_used_again(series.px))
    gamma = inversion.temporal_coherence(stack, series)
    dem = series.px.select("row", "col", "dem_error_m") if "dem_error_m" in series.px.columns else None
    series = series.with_px(series.px.select("row", "col", "disp"))
    if should_apply_aps(len(m.epochs), config.aps_window):
        series = filters.correct_aps(series, config.aps_sigma, config.aps_window)
    if config.deramp:
        series = filters.deramp(series, config.deramp)
    return Products(series, inversion.velocity(series), gamma, None, closures, flags, dem, lost)


def run_sbas_isce(spark: SparkSession, folder: str, config: SbasConfig | None = None, files: isce.IsceConfig | None = None) -> Products:
    """From unwrapped ISCE pairs; the reference is stated, else the most coherent pixel, else the grid's centre."""
    config = config or SbasConfig()
    if config.solver.weights not in (None, "unit"):
        stack = isce.read_unwrapped(spark, folder, files)
        if "coh" not in stack.px.columns:
            raise InversionError("weights need coherence")
    else:
        try:
            stack = isce.read_unwrapped(spark, folder, files)
        except MetadataError:
            stack = isce.read_unwrapped(spark, folder, files, coherence=False)
    stack = stack.with_px(_used_again(stack.px))
    stack, flags, closures = _closure(stack, config.correct_closure)
    stack, lost = _reference(stack, config.reference, config.reference_region, (stack.shape[0] // 2, stack.shape[1] // 2))
    series = _solved(stack, config.solver)
    series = series.with_px(_used_again(series.px))
    gamma = inversion.temporal_coherence(stack, series)
    dem = series.px.select("row", "col", "dem_error_m") if "dem_error_m" in series.px.columns else None
    series = series.with_px(series.px.select("row", "col", "disp"))
    if config.deramp:
        series = filters.deramp(series, config.deramp)
    std = inversion.velocity_uncertainty(series) if len(series.epochs) >= 3 else None
    return Products(series, inversion.velocity(series), gamma, std, closures, flags, dem, lost)


def write(products: Products, folder: str) -> None:
    """velocity.tif, series/, temporal_coherence.tif and, where there are any, the other maps."""
    s = products.series
    s = s.with_px(s.px.select("row", "col", "disp").persist())
    maps = {"velocity": products.velocity, "temporal_coherence": products.temporal_coherence, "velocity_std": products.velocity_std, "closure_qc": products.closures, "dem_error": products.dem_error}
    for name, df in maps.items():
        if df is not None:
            geotiff.write_map(df, df.columns[-1], s.shape, s.meta, f"{folder}/{name}.tif")
    manifest.write_series(s, f"{folder}/series")
    s.px.unpersist()


def with_meta(series: Series, **changes) -> Series:
    return replace(series, meta=replace(series.meta, **changes))
