"""Gap filling on a grid by ordinary kriging and by regression kriging: variogram of all pairs, nearest samples, batched systems.

Distances are in pixels. The experimental variogram counts every pair of samples up to a distance: a
task takes a tile with the margin that its pairs reach into and gets all offsets at once from products
of Fourier transforms, and only sums by lag leave it. Nearest samples come from squares of pixels with a margin; gaps whose neighbours are not surely within
the margin go on to squares and margins of twice the size, so sparse places cost more rounds and
nothing is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fringeflow.errors import DimensionMismatch, InversionError, MetadataError
from fringeflow.operators.cube import numbers
from fringeflow.store import discard, materialize

LAGS, NEIGHBOURS = 15, 40
#: Side of the tiles that a variogram is summed over (at least the distance it goes to), and of the buckets of the first round.
TILE, BUCKET = 256, 16
#: A task holds squares of so many buckets along each axis, with a bucket's width of samples around.
SPREAD = 4
#: Systems solved at once.
BATCH = 512
MODELS = ("spherical", "exponential", "gaussian")


@dataclass(frozen=True)
class Variogram:
    """Semivariance nugget + sill * shape(h / reach); 0 at h = 0. The reach is where a spherical one is flat and the others have 95 % of their sill."""

    kind: str
    nugget: float
    sill: float
    reach: float
    wsse: float = 0.0

    def shape(self, h):
        x = np.asarray(h, float) / self.reach
        if self.kind == "spherical":
            return np.where(x < 1, 1.5 * x - 0.5 * x**3, 1.0)
        return 1 - np.exp(-3 * x) if self.kind == "exponential" else 1 - np.exp(-3 * x * x)

    def covariance(self, h):
        return np.where(np.asarray(h) == 0, self.nugget + self.sill, self.sill * (1 - self.shape(h)))


def _sums_of_pairs(base: np.ndarray, wide: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum of squared differences) of pairs (x in base, x + h in wide) by offset h: rows 0 .. reach, columns -reach .. reach.

    wide is base with reach more rows below and reach more columns on either side; NaN is no sample.
    """
    size = [n + m - 1 for n, m in zip(wide.shape, base.shape, strict=True)]
    there = [np.isfinite(x).astype(float) for x in (base, wide)]
    value = [np.nan_to_num(x) for x in (base, wide)]

    def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        full = np.fft.irfft2(np.conj(np.fft.rfft2(a, size)) * np.fft.rfft2(b, size), size)
        return full[: reach + 1, : 2 * reach + 1]

    count = np.round(across(there[0], there[1]))
    squares = across(value[0] ** 2, there[1]) + across(there[0], value[1] ** 2) - 2 * across(value[0], value[1])
    return count, squares


def variogram(samples: DataFrame, max_distance: float, lags: int = LAGS, value: str = "value") -> DataFrame:
    """samples(row, col, value) -> lag, distance (mean), gamma, pairs: all pairs of samples no further apart than max_distance, in equal lags that include their upper ends.

    NULL and not finite values are no samples; of rows that repeat a pixel one counts. Lags without pairs have no row.
    """
    reach = int(max_distance)
    if not (lags > 0 and reach >= 1):
        raise MetadataError("a variogram needs lags and a distance of a pixel at least")
    tile = max(TILE, reach)
    v = F.col(value).cast("double")
    known = samples.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    mean = known.agg(F.avg("v")).first()[0] or 0.0  # squares of smaller numbers lose less
    tr = F.explode(F.sequence(F.floor((F.col("row") - reach) / tile), F.floor(F.col("row") / tile)))
    tc = F.explode(F.sequence(F.floor((F.col("col") - reach) / tile), F.floor((F.col("col") + reach) / tile)))
    dealt = known.withColumn("v", F.col("v") - mean).withColumn("tr", tr).withColumn("tc", tc)
    dr, dc = np.indices((reach + 1, 2 * reach + 1))
    dc = dc - reach
    d = np.sqrt(dr * dr + dc * dc)
    use = (d <= max_distance) & ((dr > 0) | (dc > 0))
    lag = np.where(use, np.ceil(d * lags / max_distance - 1e-9) - 1, -1).astype(int)

    def sums(t: pa.Table) -> pa.Table:
        top, left = t["tr"][0].as_py() * tile, t["tc"][0].as_py() * tile
        wide = np.full((tile + reach, tile + 2 * reach), np.nan)
        wide[t["row"].to_numpy() - top, t["col"].to_numpy() - left + reach] = t["v"].to_numpy()
        base = wide[:tile, reach : reach + tile]
        if not np.isfinite(base).any():
            return pa.table({k: pa.array([], pa.float64()) for k in ("lag", "n", "h", "s")})
        n, s = _sums_of_pairs(base, wide, reach)
        per = [np.bincount(lag[use], x[use], lags) for x in (n, n * d, s)]
        return pa.table({"lag": np.arange(lags, dtype=float), **dict(zip(("n", "h", "s"), per, strict=True))})

    per = dealt.groupBy("tr", "tc").applyInArrow(sums, "lag double, n double, h double, s double").groupBy("lag").agg(*(F.sum(c).alias(c) for c in ("n", "h", "s"))).where("n > 0")
    return per.select(F.col("lag").cast("int").alias("lag"), (F.col("h") / F.col("n")).alias("distance"), F.greatest(F.col("s") / (2 * F.col("n")), F.lit(0.0)).alias("gamma"), F.col("n").cast("long").alias("pairs"))


def fit(lags: list[tuple[float, float, float]], kinds: tuple[str, ...] = MODELS) -> Variogram:
    """The model of the least squares weighted by pairs over (distance, gamma, pairs): nugget and sill not negative, best reach up to twice the last lag."""
    if not lags:
        raise InversionError("no lags to fit a variogram to")
    h, g, w = (np.array(x, float) for x in zip(*lags, strict=True))
    w = w / w.sum()
    best = None
    for kind in kinds:
        def at(reach: float, kind: str = kind) -> Variogram:
            x = Variogram(kind, 0, 1, reach).shape(h)
            options = [(0.0, max(0.0, (w * x * g).sum() / max((w * x * x).sum(), 1e-300))), (max(0.0, (w * g).sum()), 0.0)]
            a = np.array([[1.0, (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]])
            if np.linalg.det(a) > 1e-12:
                n, s = np.linalg.solve(a, [(w * g).sum(), (w * x * g).sum()])
                if n >= 0 and s >= 0:
                    options.append((n, s))
            return min((Variogram(kind, float(n), float(s), reach, float((w * (n + s * x - g) ** 2).sum())) for n, s in options), key=lambda m: m.wsse)

        grid = np.geomspace(max(h.min() / 2, 1e-6), 2 * h.max(), 61)
        k = int(np.argmin([at(r).wsse for r in grid]))
        low, high = grid[max(0, k - 1)], grid[min(60, k + 1)]
        for _ in range(60):
            a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
            low, high = (low, b) if at(a).wsse <= at(b).wsse else (a, high)
        for m in (at(float(grid[k])), at(float((low + high) / 2))):
            if best is None or m.wsse < best.wsse:
                best = m
    return best


def fitted(samples: DataFrame, max_distance: float, lags: int = LAGS, value: str = "value", kinds: tuple[str, ...] = MODELS) -> Variogram:
    rows = variogram(samples, max_distance, lags, value).orderBy("lag").collect()  # a row a lag
    return fit([(r["distance"], r["gamma"], r["pairs"]) for r in rows], kinds)


def solve(model: Variogram, gap: np.ndarray, at: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and kriging variances: gaps (m, 2, whole pixels), their k neighbours' places (m, k, 2) and values (m, k)."""
    k = z.shape[1]
    if model.nugget + model.sill <= 0:
        return z.mean(axis=1), np.zeros(len(z))
    a = np.ones((len(z), k + 1, k + 1))
    a[:, :k, :k] = _covariances(model, _squared(at[:, :, None], at[:, None]))
    a[:, np.arange(k), np.arange(k)] += 1e-10 * (model.nugget + model.sill)
    a[:, k, k] = 0
    b = np.ones((len(z), k + 1, 1))
    b[:, :k, 0] = _covariances(model, _squared(at, gap[:, None]))
    x = np.linalg.solve(a, b)[:, :, 0]
    return (x[:, :k] * z).sum(axis=1), np.maximum(model.nugget + model.sill - (x * b[:, :, 0]).sum(axis=1), 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of pixels."""
    r, c = a[..., 0] - b[..., 0], a[..., 1] - b[..., 1]
    return r * r + c * c


def _covariances(model: Variogram, squared: np.ndarray) -> np.ndarray:
    """By squared distance in pixels; short ones, of which there are few different, from a table."""
    most = int(squared.max(initial=0))
    if most < squared.size and most < 1 << 20:
        return model.covariance(np.sqrt(np.arange(most + 1)))[squared]
    return model.covariance(np.sqrt(squared))


def _nearest(gaps: np.ndarray, samples: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in samples (sorted by row, column) of each gap's k nearest, ties by row and column; and the squared distance of the last."""
    middle = (gaps.min(axis=0) + gaps.max(axis=0)) / 2
    away = np.sqrt(_squared(samples, middle))
    near = np.arange(len(samples))
    if len(samples) > k:
        half = np.sqrt(_squared(gaps, middle)).max()
        near = np.flatnonzero(away <= np.partition(away, k - 1)[k - 1] + 2 * half + 1e-9)
    d = _squared(gaps[:, None], samples[near][None])
    key = d.astype(np.int64) * len(near) + np.arange(len(near))
    k = min(k, len(near))
    first = np.argpartition(key, k - 1, axis=1)[:, :k]
    first = np.take_along_axis(first, np.argsort(np.take_along_axis(key, first, 1), axis=1), 1)
    return near[first], np.take_along_axis(d, first[:, -1:], 1)[:, 0]


def _predict(model: Variogram, k: int, side: int, last: bool):
    """Of a bucket: the estimates of its gaps, where their neighbours are surely the nearest there are."""

    def one(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        place = np.stack([t["row"].to_numpy(), t["col"].to_numpy()], axis=1)
        corner = place.min(axis=0)
        place = (place - corner).astype(np.int32 if place.max(initial=0) - place.min(initial=0) < 1 << 14 else np.int64)  # squares of distances stay whole
        gaps, known = place[kind == 1], kind == 0
        samples, z = place[known], t["v"].to_numpy(zero_copy_only=False)[known]
        order = np.lexsort((samples[:, 1], samples[:, 0]))
        samples, z = samples[order], z[order].astype(float)
        value, var, sure, used = np.full(len(gaps), np.nan), np.full(len(gaps), np.nan), np.zeros(len(gaps), bool), np.zeros(len(gaps), int)
        if len(samples):
            fine = (gaps // BUCKET).astype(np.int64) @ np.array([1 << 31, 1])
            order = np.argsort(fine, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(fine[order])) + 1):
                at, far = _nearest(gaps[rows], samples, k)
                ok = np.full(len(rows), True) if last else (at.shape[1] == k) & (far <= side * side)
                sure[rows] = ok
                for s in range(0, int(ok.sum()), BATCH):
                    r, n = rows[ok][s : s + BATCH], at[ok][s : s + BATCH]
                    value[r], var[r] = solve(model, gaps[r], samples[n], z[n])
                    used[r] = n.shape[1]
        elif last:
            sure[:] = True
        gaps = gaps.astype(np.int64) + corner
        return pa.table({"row": gaps[:, 0], "col": gaps[:, 1], "sure": sure, "value": numbers(value), "sigma": numbers(np.sqrt(var)), "neighbours": pa.array(used, pa.int32())})

    return one


def krige(px: DataFrame, model: Variogram, neighbours: int = NEIGHBOURS, value: str = "value") -> DataFrame:
    """px(row, col, value) -> row, col, value, sigma, neighbours of every pixel without a value: ordinary kriging from its nearest pixels that have one.

    Ties between neighbours go to the smaller row, then column. Where there are fewer samples than `neighbours` all are used, without any the value is NULL.
    Not finite values count as gaps. Of rows that repeat a sampled pixel one is taken, rows that repeat a gap have an estimate each.
    """
    if neighbours < 1:
        raise DimensionMismatch("kriging needs a neighbour at least")
    v = F.col(value).cast("double")
    rows = px.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("v"))
    rows = materialize(rows, "kriging")
    known = rows.where("v is not null").dropDuplicates(["row", "col"])
    ends = known.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    gaps = rows.where("v is null").select("row", "col")
    span = gaps.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    side, out, before = BUCKET, None, None
    extent = 0 if span[0] is None or ends[0] is None else max(max(span[1], ends[1]) - min(span[0], ends[0]), max(span[3], ends[3]) - min(span[2], ends[2]))
    while True:
        last = side > extent
        here = lambda c, off=0, wide=side * SPREAD: F.floor((F.col(c) + off) / wide)
        own = gaps.select("row", "col", F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind"), here("row").alias("br"), here("col").alias("bc"))
        around = {"br": F.explode(F.sequence(here("row", -side), here("row", side))), "bc": F.explode(F.sequence(here("col", -side), here("col", side)))}
        spread = known.select("row", "col", "v", F.lit(0).alias("kind")).withColumn("br", around["br"]).withColumn("bc", around["bc"])
        spread = spread.join(own.select("br", "bc").distinct(), ["br", "bc"], "left_semi").select(own.columns)
        done = own.unionByName(spread).groupBy("br", "bc").applyInArrow(_predict(model, neighbours, side, last), "row long, col long, sure boolean, value double, sigma double, neighbours int")
        done = materialize(done, "estimates")
        good = done.where("sure").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value", "sigma", "neighbours")
        out = good if out is None else out.unionByName(good)
        if last or done.where("not sure").limit(1).count() == 0:
            return out
        gaps, before, side = done.where("not sure").select("row", "col"), done, side * 2


def fill(px: DataFrame, max_distance: float, neighbours: int = NEIGHBOURS, lags: int = LAGS, value: str = "value") -> tuple[DataFrame, Variogram]:
    """px with its gaps filled: row, col, value, sigma (0 where the value was known), filled; and the variogram, the best of three models."""
    model = fitted(px, max_distance, lags, value)
    v = F.col(value).cast("double")
    known = px.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), v.alias("value"), F.lit(0.0).alias("sigma"), F.lit(False).alias("filled"))
    made = krige(px, model, neighbours, value).select("row", "col", "value", "sigma", F.lit(True).alias("filled"))
    return known.unionByName(made), model


def slope(px: DataFrame, shape: tuple[int, int], height: str = "height_m") -> DataFrame:
    """px with `slope`: half the differences of the heights beside, above and below; the pixel itself stands in for a neighbour beyond the edge. NULL where a neighbour has no height."""
    if min(shape) < 1:
        raise DimensionMismatch("the grid is empty")

    def half(along: str, other: str, n: int):
        w = Window.partitionBy(other).orderBy(along)
        beside = lambda f, step, edge: F.when(F.col(along) == edge, F.col(height)).when(f(F.col(along)).over(w) == F.col(along) + step, f(F.col(height)).over(w))
        return (beside(F.lead, 1, n - 1) - beside(F.lag, -1, 0)) / 2

    dx, dy = half("col", "row", shape[1]), half("row", "col", shape[0])
    return px.withColumn("__dx", dx).withColumn("__dy", dy).withColumn("slope", F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy"))).drop("__dx", "__dy")


def regression_fill(px: DataFrame, covariates: list[str], max_distance: float, neighbours: int = NEIGHBOURS, lags: int = LAGS, value: str = "value", trees: int = 200, depth: int = 5, seed: int = 1) -> tuple[DataFrame, Variogram, float]:
    """A trend of the covariates by a random forest, its residuals kriged: row, col, value, trend, sigma, filled; the residuals' variogram; and R2 on the tenth parts that no tree saw.

    Pixels that lack a covariate are left out, as is every row with a NULL place. R2 is of a forest fitted on seven tenths of the samples
    (by a hash of their places), over the others; the one that predicts has all samples.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    ready = px.where(F.expr(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in covariates)))
    v = F.col(value).cast("double")
    cols = ready.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("y"), *(F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate(covariates)))
    table = materialize(VectorAssembler(inputCols=[f"__{k}" for k in range(len(covariates))], outputCol="features").transform(cols).select("row", "col", "y", "features"), "terrain")
    known = table.where("y is not null")
    if not known.limit(1).count():
        raise InversionError("no samples to fit a trend to")
    forest = RandomForestRegressor(labelCol="y", featuresCol="features", predictionCol="trend", numTrees=trees, maxDepth=depth, seed=seed)
    test = F.pmod(F.xxhash64("row", "col"), F.lit(10)) >= 7
    score, trained, held = float("nan"), known.where(~test), known.where(test)
    if trained.limit(1).count() and held.limit(1).count():
        s = forest.fit(trained).transform(held).agg(F.sum((F.col("y") - F.col("trend")) ** 2).alias("e"), (F.var_pop("y") * F.count("y")).alias("t")).first()
        score = 1 - s["e"] / s["t"] if s["t"] else float("nan")
    trend = materialize(forest.fit(known).transform(table).select("row", "col", "y", "trend", (F.col("y") - F.col("trend")).alias("rest")), "trend")
    model = fitted(trend, max_distance, lags, "rest")
    made = krige(trend.select("row", "col", "rest"), model, neighbours, "rest").select("row", "col", F.col("value").alias("r"), "sigma")
    gaps = trend.where("y is null").select("row", "col", "trend").join(made, ["row", "col"]).select("row", "col", (F.col("trend") + F.col("r")).alias("value"), "trend", "sigma", F.lit(True).alias("filled"))
    own = trend.where("y is not null").select("row", "col", F.col("y").alias("value"), "trend", F.lit(0.0).alias("sigma"), F.lit(False).alias("filled"))
    discard(table)
    return own.unionByName(gaps), model, score
