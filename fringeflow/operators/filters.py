"""Corrections of a series: ramps, topography, atmosphere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, InversionError, MetadataError
from fringeflow.operators import kernels
from fringeflow.operators.cube import Series, lists, map_pixels, matrix, numbers, to_pixels, years

#: Side of the tiles that a spatial filter is cut into (each with the margin that its window needs).
TILE = 512
#: Pixels whose terms are held at once.
SUMMED = 512


def _sums(px: DataFrame, columns: list[str], n: int, terms) -> np.ndarray:
    """Sums over all pixels of terms(*columns), an array (pixels, n, k): added up in each batch, then in Spark; (n, k) come back."""

    def run(batches):
        total = None
        for b in batches:
            for s in range(0, b.num_rows, SUMMED):
                part = terms(*(b.column(c).slice(s, SUMMED) for c in columns)).sum(axis=0)
                total = part if total is None else total + part
        if total is not None:
            e, k = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(e.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(total.ravel())], ["e", "k", "x"])

    rows = px.select(*columns).mapInArrow(run, "e int, k int, x double").groupBy("e", "k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((n, 1 + max((r["k"] for r in rows), default=0)))
    for r in rows:
        out[r["e"], r["k"]] = r["x"]
    return out


def ramp_basis(row: np.ndarray, col: np.ndarray, shape: tuple[int, int], model: str = "linear") -> np.ndarray:
    x, y = col / (shape[1] - 1), row / (shape[0] - 1)
    one = np.ones_like(x)
    if model == "linear":
        return np.stack([x, y, one], axis=1)
    if model == "quadratic":
        return np.stack([x, y, one, x * x, y * y, x * y], axis=1)
    raise MetadataError(f"unknown ramp {model}")


def _solve(sums: np.ndarray, m: int) -> np.ndarray:
    """Least-norm coefficients for each layer from its sums (Gram matrix, right side, count)."""
    out = np.zeros((len(sums), m))
    for e, s in enumerate(sums):
        out[e] = np.linalg.pinv(s[: m * m].reshape(m, m), rcond=1e-12, hermitian=True) @ s[m * m : m * m + m]
    return out


def deramp(series: Series, model: str = "linear", mask: str | None = None) -> Series:
    """Each epoch less a plane (or quadratic surface) fitted to its valid pixels; `mask`: a BOOLEAN column that restricts the fit only.

    Two passes over the pixels and no shuffle of them: sums for the fit, then the correction. An epoch
    without data at all is left as it is; one with fewer valid pixels than coefficients is an error.
    """
    if min(series.shape) < 2:
        raise DimensionMismatch("a ramp needs at least 2 x 2 pixels")
    n, shape = len(series.epochs), series.shape
    m = 3 if model == "linear" else 6
    ramp_basis(np.zeros(1), np.zeros(1), shape, model)

    def terms(row, col, disp, fit=None):
        b = ramp_basis(row.to_numpy(), col.to_numpy(), shape, model)
        d = matrix(disp, n)
        ok = np.isfinite(d)
        if fit is not None:
            ok &= np.array([bool(x) for x in fit.to_pylist()])[:, None]
        gram = (b[:, :, None] * b[:, None, :]).reshape(len(b), 1, m * m) * ok[:, :, None]
        right = b[:, None, :] * np.where(ok, d, 0.0)[:, :, None]
        return np.concatenate([gram, right, ok[:, :, None].astype(float), np.isfinite(d)[:, :, None].astype(float)], axis=2)

    sums = _sums(series.px, ["row", "col", "disp", *([mask] if mask else [])], n, terms)
    if sums.shape[1] < m * m + m + 2:
        return series
    if ((sums[:, -2] < m) & (sums[:, -1] > 0)).any():
        raise InversionError(f"an epoch has fewer than {m} pixels to fit")
    c = _solve(sums, m)

    def kernel(row, col, disp):
        return [lists(matrix(disp, n) - ramp_basis(row.to_numpy(), col.to_numpy(), shape, model) @ c.T)]

    return series.with_px(map_pixels(series.px, ["row", "col", "disp"], kernel, {"disp": "array<double>"}))


def deramp_map(values: DataFrame, value: str, shape: tuple[int, int], model: str = "linear", mask: str | None = None) -> DataFrame:
    """deramp() of one map (row, col, value)."""
    from datetime import date

    px = values.withColumn("disp", F.array(F.col(value).cast("double")))
    out = deramp(Series(px, (date(2000, 1, 1),), shape), model, mask).px
    return out.withColumn(value, F.col("disp")[0]).drop("disp")


def correct_topography(series: Series, degree: int = 1, ramp: bool = False, height: str = "height_m", mask: str | None = None) -> Series:
    """Each epoch less the part that goes with height: k1 h + k2 h^2 of a fit that also has a constant (and a plane); heights are normalised per epoch."""
    if degree not in (1, 2):
        raise MetadataError("degree must be 1 or 2")
    n, shape = len(series.epochs), series.shape
    m = 1 + degree + 2 * ramp

    def valid(disp, h, fit):
        ok = np.isfinite(disp) & np.isfinite(h)[:, None]
        return ok if fit is None else ok & np.array([bool(x) for x in fit.to_pylist()])[:, None]

    def column(a: pa.Array) -> np.ndarray:
        x = a.to_numpy(zero_copy_only=False).astype(float)
        return np.where(np.isfinite(x), x, np.nan)

    extra = [mask] if mask else []

    def spread(batches):
        for b in batches:
            if b.num_rows:
                h = column(b.column("h"))
                ok = valid(matrix(b.column("disp"), n), h, b.column("fit") if mask else None)
                z = np.where(ok, np.where(np.isfinite(h), h, 0.0)[:, None], np.nan)
                with np.errstate(all="ignore"):
                    import warnings

                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        low, high = np.nanmin(z, axis=0), np.nanmax(z, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(ok.sum(axis=0).astype(float)), pa.array(np.nansum(z, axis=0)), numbers(low), numbers(high)], ["e", "n", "s", "low", "high"])

    shown = series.px.select(F.col("disp"), F.col(height).cast("double").alias("h"), *(F.col(x).alias("fit") for x in extra))
    stats = {r["e"]: r for r in shown.mapInArrow(spread, "e int, n double, s double, low double, high double").groupBy("e").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    mean, scale, count = np.zeros(n), np.ones(n), np.zeros(n)
    for e, r in stats.items():
        count[e] = r["n"]
        if r["n"]:
            mean[e] = r["s"] / r["n"]
            scale[e] = max(r["high"] - mean[e], mean[e] - r["low"], 1e-6)
    if ((count < m) & (count > 0)).any():
        raise InversionError(f"an epoch has fewer than {m} pixels to fit")

    def basis(row, col, h):
        z = (h[:, None] - mean) / scale
        cols = [np.ones_like(z), z, *([z * z] if degree == 2 else [])]
        if ramp:
            x, y = col / (max(shape[1], 2) - 1), row / (max(shape[0], 2) - 1)
            cols += [np.broadcast_to(x[:, None], z.shape), np.broadcast_to(y[:, None], z.shape)]
        return np.stack(cols, axis=2)

    def terms(row, col, disp, h, fit=None):
        d, h = matrix(disp, n), column(h)
        ok = valid(d, h, fit)
        b = np.where(ok[:, :, None], basis(row.to_numpy(), col.to_numpy(), np.nan_to_num(h)), 0.0)
        gram = (b[:, :, :, None] * b[:, :, None, :]).reshape(*b.shape[:2], m * m)
        return np.concatenate([gram, b * np.where(ok, d, 0.0)[:, :, None]], axis=2)

    px = series.px.withColumn("__h", F.col(height).cast("double"))
    c = _solve(_sums(px, ["row", "col", "disp", "__h", *extra], n, terms), m)

    def kernel(row, col, disp, h):
        d, h = matrix(disp, n), column(h)
        b = basis(row.to_numpy(), col.to_numpy(), h)[:, :, 1 : 1 + degree]
        part = np.einsum("pek,ek->pe", b, c[:, 1 : 1 + degree])
        return [lists(np.where(np.isfinite(part), d - part, d))]

    return series.with_px(map_pixels(px, ["row", "col", "disp", "__h"], kernel, {"disp": "array<double>"}).drop("__h"))


def high_pass(series: Series, window: int) -> DataFrame:
    """row, col, hp ARRAY<DOUBLE>: each epoch less a local line through time; all NULL where any epoch is missing."""
    if window < 1 or window % 2 == 0:
        raise MetadataError("the temporal window must be odd")
    n = len(series.epochs)
    m = kernels.high_pass_matrix(years(series.epochs), window)
    return map_pixels(series.px, ["disp"], lambda d: [lists(matrix(d, n) @ m.T)], {"hp": "array<double>"}, ["row", "col"])


def tiled(rows: DataFrame, margin: int, tile: int = TILE) -> DataFrame:
    """Long rows with tile_r, tile_c, a copy for each tile whose margin they lie in."""

    def tiles(x: str) -> Column:
        return F.sequence(F.floor((F.col(x) - margin) / tile).cast("int"), F.floor((F.col(x) + margin) / tile).cast("int"))

    return rows.withColumn("tile_r", F.explode(tiles("row"))).withColumn("tile_c", F.explode(tiles("col")))


def low_pass(rows: DataFrame, layer: str, value: str, sigma: float, tile: int = TILE) -> DataFrame:
    """Long rows (row, col, layer, value) -> the same with a Gaussian mean of valid neighbours; NULL stays NULL.

    A task holds one tile of one layer with its margin, whatever the size of the scene.
    """
    if not (np.isfinite(sigma) and sigma > 0):
        raise MetadataError("sigma must be finite and positive")
    margin = int(np.ceil(3 * sigma))

    def one(t: pa.Table) -> pa.Table:
        r, c = t["row"].to_numpy(), t["col"].to_numpy()
        v = t[value].to_numpy(zero_copy_only=False).astype(float)
        tr, tc = t["tile_r"][0].as_py() * tile, t["tile_c"][0].as_py() * tile
        grid = np.full((tile + 2 * margin, tile + 2 * margin), np.nan)
        grid[r - tr + margin, c - tc + margin] = v
        lo = np.array([r.min() - tr + margin, c.min() - tc + margin])
        hi = np.array([r.max() - tr + margin + 1, c.max() - tc + margin + 1])
        grid[lo[0] : hi[0], lo[1] : hi[1]] = kernels.low_pass(grid[lo[0] : hi[0], lo[1] : hi[1]], sigma)
        own = (r // tile * tile == tr) & (c // tile * tile == tc)
        out = grid[r[own] - tr + margin, c[own] - tc + margin]
        return pa.table({"row": pa.array(r[own]), "col": pa.array(c[own]), layer: t[layer].filter(pa.array(own)), value: numbers(out)})

    dealt = tiled(rows.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col(layer).cast("int"), F.col(value).cast("double")), margin, tile)
    return dealt.groupBy(layer, "tile_r", "tile_c").applyInArrow(one, f"row int, col int, {layer} int, {value} double")


def correct_aps(series: Series, sigma: float = 8.0, window: int = 5) -> Series:
    """Without what is smooth in space but not in time; pixels with a missing epoch stay as they are."""
    n = len(series.epochs)
    hp = high_pass(series, window)
    whole = hp.where(F.exists("hp", lambda x: x.isNotNull()))
    smooth = low_pass(whole.select("row", "col", F.posexplode("hp").alias("epoch_idx", "v")), "epoch_idx", "v", sigma)
    aps = to_pixels(smooth, "epoch_idx", n, aps="v")
    both = series.px.join(aps, ["row", "col"], "left")
    less = F.when(F.col("aps").isNull(), F.col("disp")).otherwise(F.zip_with("disp", "aps", lambda d, a: d - F.coalesce(a, F.lit(0.0))))
    return series.with_px(both.withColumn("disp", less).drop("aps"))
