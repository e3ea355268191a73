"""Delays from atmospheric profiles, and their correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch
from fringeflow.functions.phase import GAS_RATIO, K2_PRIME, K3, saastamoinen_zhd, valid
from fringeflow.operators.cube import Series

LEVEL = "struct<height_m: double, pressure_hpa: double, temperature_k: double, specific_humidity: double>"
_SAME_M = 1e-9


def _levels(profile: Column) -> Column:
    """Levels by height; a profile of fewer than two stops the query."""
    good = F.filter(profile, lambda x: x["height_m"].isNotNull())
    checked = F.when(F.size(good) >= 2, good).otherwise(F.raise_error(F.lit("a profile needs at least two levels")).cast(f"array<{LEVEL}>"))
    return F.array_sort(checked, lambda a, b: F.when(a["height_m"] < b["height_m"], -1).when(a["height_m"] > b["height_m"], 1).otherwise(0))


def interpolate(profile: Column, height_m: Column) -> Column:
    """The level at height_m: temperature and humidity linear, pressure log-linear, beyond the ends from the last two levels."""
    levels = _levels(profile)
    n = F.size(levels)
    below = F.size(F.filter(levels, lambda x: x["height_m"] <= height_m))
    i = F.least(F.greatest(below, F.lit(1)), n - 1)
    a, b = F.element_at(levels, i), F.element_at(levels, i + 1)
    dz = b["height_m"] - a["height_m"]
    f = F.when(F.abs(dz) < _SAME_M, F.lit(0.0)).otherwise((height_m - a["height_m"]) / F.when(F.abs(dz) < _SAME_M, F.lit(1.0)).otherwise(dz))

    def linear(k: str) -> Column:
        return a[k] + f * (b[k] - a[k])

    pressure = F.exp(F.log(a["pressure_hpa"]) + f * (F.log(b["pressure_hpa"]) - F.log(a["pressure_hpa"])))
    return F.struct(height_m.cast("double").alias("height_m"), pressure.alias("pressure_hpa"), linear("temperature_k").alias("temperature_k"), linear("specific_humidity").alias("specific_humidity"))


def _wet(x: Column) -> Column:
    e = x["specific_humidity"] * x["pressure_hpa"] / (GAS_RATIO + (1 - GAS_RATIO) * x["specific_humidity"])
    return K2_PRIME * e / x["temperature_k"] + K3 * e / (x["temperature_k"] * x["temperature_k"])


def zenith_wet(profile: Column, height_m: Column) -> Column:
    """Zenith wet delay, metres: the trapezoid rule from height_m, at an interpolated level, up to the last level."""
    above = F.filter(_levels(profile), lambda x: x["height_m"] > height_m + _SAME_M)
    levels = F.concat(F.array(interpolate(profile, height_m)), above)
    lower = F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0)))
    steps = F.zip_with(lower, F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: (b["height_m"] - a["height_m"]) * (_wet(a) + _wet(b)) / 2)
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) * 1e-6


def zenith_delay(profile: Column, height_m: Column, latitude_deg: Column) -> Column:
    return saastamoinen_zhd(interpolate(profile, height_m)["pressure_hpa"], latitude_deg, height_m) + zenith_wet(profile, height_m)


def profiles_at(nodes: DataFrame, px: DataFrame, origin: tuple[float, float], spacing: tuple[float, float]) -> DataFrame:
    """nodes(epoch_idx, lat, lon, levels) of a coarse regular grid, px(row, col, lat, lon, ...) -> px's columns, epoch_idx, levels: bilinear between the four corners, level by level.

    `origin` and `spacing` are latitude and longitude of the first node and of a step (either may be negative). Each node goes
    to the four cells that it is a corner of, so one join by cell serves all pixels and no pixel looks for its
    corners. Pixels outside the grid, or in a cell that lacks a corner, have NULL levels; a pixel without any has no epoch. Corners
    whose numbers of levels differ stop the query; levels are matched by their place.
    """
    ends = nodes.agg(F.max(F.round((F.col("lat") - origin[0]) / spacing[0])), F.max(F.round((F.col("lon") - origin[1]) / spacing[1]))).first()
    if ends[0] is None or min(ends) < 1:
        raise DimensionMismatch("the weather grid needs two nodes along each axis")
    n, m = int(ends[0]), int(ends[1])
    i, j = (F.round((F.col(c) - o) / d).cast("int") for c, o, d in zip(("lat", "lon"), origin, spacing, strict=True))
    corner = F.explode(F.array(*[F.struct((i - a).alias("i"), (j - b).alias("j"), F.lit(2 * a + b).alias("k")) for a in (0, 1) for b in (0, 1)]))
    at = nodes.select("epoch_idx", "levels", corner.alias("c")).select("epoch_idx", "levels", "c.*").where(F.col("i").between(0, n - 1) & F.col("j").between(0, m - 1))
    cells = at.groupBy("epoch_idx", F.col("i").alias("__i"), F.col("j").alias("__j")).agg(*(F.first(F.when(F.col("k") == k, F.col("levels")), ignorenulls=True).alias(f"__{k}") for k in range(4)))
    u, v = ((F.col(c) - o) / d for c, o, d in zip(("lat", "lon"), origin, spacing, strict=True))
    cell = lambda x, most: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(most - 1)).cast("int")
    placed = px.withColumns({"__u": u, "__v": v}).withColumns({"__i": cell(F.col("__u"), n), "__j": cell(F.col("__v"), m)})
    both = placed.join(cells, ["__i", "__j"], "left").withColumns({"__u": F.col("__u") - F.col("__i"), "__v": F.col("__v") - F.col("__j")})
    inside = F.col("__u").between(-1e-9, 1 + 1e-9) & F.col("__v").between(-1e-9, 1 + 1e-9)
    weights = [(1 - F.col("__u")) * (1 - F.col("__v")), (1 - F.col("__u")) * F.col("__v"), F.col("__u") * (1 - F.col("__v")), F.col("__u") * F.col("__v")]
    sizes = [F.size(f"__{k}") for k in range(4)]
    same = (sizes[0] == sizes[1]) & (sizes[0] == sizes[2]) & (sizes[0] == sizes[3])
    whole = F.expr(" and ".join(f"`__{k}` is not null" for k in range(4)))

    def between(x: Column) -> Column:
        return F.struct(*[sum(w * x[f"__{k}"][name] for k, w in enumerate(weights)).alias(name) for name in ("height_m", "pressure_hpa", "temperature_k", "specific_humidity")])

    levels = F.transform(F.arrays_zip(*[F.col(f"__{k}") for k in range(4)]), between)
    checked = F.when(inside & whole, F.when(same, levels).otherwise(F.raise_error(F.lit("corners of a weather cell have different levels")).cast(f"array<{LEVEL}>")))
    return both.select(*px.columns, "epoch_idx", checked.alias("levels"))


def delays_at(nodes: DataFrame, px: DataFrame, origin: tuple[float, float], spacing: tuple[float, float], incidence_deg: float) -> DataFrame:
    """row, col, epoch_idx, delay_m: the delay along the line of sight of px(row, col, lat, lon, height_m) from a weather grid (see profiles_at)."""
    if not 0 <= incidence_deg < 90:
        raise DimensionMismatch("the incidence must be from 0 to below 90 degrees")
    got = profiles_at(nodes, px.select("row", "col", "lat", "lon", "height_m"), origin, spacing).where("epoch_idx is not null")
    delay = F.when(F.col("levels").isNotNull(), zenith_delay(F.col("levels"), F.col("height_m"), F.col("lat")))
    return got.select("row", "col", "epoch_idx", (delay / F.cos(F.radians(F.lit(float(incidence_deg))))).alias("delay_m"))


def correct_series(series: Series, delays: DataFrame, reference: int = 0) -> Series:
    """disp[e] + delay[e] - delay[reference]; delays(row, col, delay ARRAY<DOUBLE>). What lacks a delay stays as it is."""
    if not 0 <= reference < len(series.epochs):
        raise DimensionMismatch(f"epoch {reference} is outside the series")
    both = series.px.join(delays.select("row", "col", F.transform("delay", valid).alias("__d")), ["row", "col"], "left")
    base = F.try_element_at("__d", F.lit(reference + 1))
    moved = F.transform("disp", lambda d, i: d + F.coalesce(F.try_element_at(F.col("__d"), i + 1) - base, F.lit(0.0)))
    return series.with_px(both.withColumn("disp", F.when(F.col("__d").isNull(), F.col("disp")).otherwise(moved)).drop("__d"))
