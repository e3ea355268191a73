"""Cubes derived, alike in Spark and in SQL, from the driver's tables.

`events` gives a grid of pixels (user_id div 10, user_id mod 10) over five-day or daily epochs, with
the summed value in whole cents as the signal; `lineitem` gives suppliers over quarters.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.functions.phase import WAVELENGTH_M, displacement_to_phase
from fringeflow.operators.cube import Meta, Pair, Series, Stack, every, to_pixels

FIRST, DAYS, EPOCHS, DAILY = date(2024, 1, 1), 5, 6, 30
SCALE = 1e-6
EPOCH_DATES = every(FIRST, DAYS, EPOCHS)
ALL_PAIRS = tuple(Pair(i, j, float((j * 37) % 101 - (i * 37) % 101)) for i in range(EPOCHS) for j in range(i + 1, EPOCHS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_series(spark: SparkSession, sf_dir: str, days: int = DAYS, n: int = EPOCHS) -> DataFrame:
    """row, col, epoch_idx, t_yr, disp_m."""
    e = table(spark, sf_dir, "events")
    epoch = F.floor(F.datediff(F.col("ts").cast("date"), F.lit(FIRST)) / days).cast("int")
    cents = F.round(F.col("value") * 100).cast("long")
    keyed = e.select((F.floor(F.col("user_id") / 10)).cast("int").alias("row"), (F.col("user_id") % 10).cast("int").alias("col"), epoch.alias("epoch_idx"), cents.alias("cents"))
    sums = keyed.where(F.col("epoch_idx").between(0, n - 1)).groupBy("row", "col", "epoch_idx").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    return sums.select("row", "col", "epoch_idx", (F.col("epoch_idx") * days / F.lit(365.25)).alias("t_yr"), (F.col("cents").cast("double") * SCALE).alias("disp_m"), "cents", "n")


def shape(long: DataFrame) -> tuple[int, int]:
    got = long.agg(F.max("row"), F.max("col")).first()
    return int(got[0] or 0) + 1, int(got[1] or 0) + 1


def series(spark: SparkSession, sf_dir: str, days: int = DAYS, n: int = EPOCHS, with_shape: bool = False) -> Series:
    long = long_series(spark, sf_dir, days, n)
    px = to_pixels(long, "epoch_idx", n, disp="disp_m")
    return Series(px, every(FIRST, days, n), shape(long) if with_shape else (1 << 30, 1 << 30))


def disp_at(k: int) -> Column:
    return F.col("disp")[k]


def stack(spark: SparkSession, sf_dir: str, pairs: tuple[Pair, ...] = ALL_PAIRS, noise: float = 0.0, jumps: bool = False, one_jump: bool = False) -> Stack:
    """Phases of each pair from the five-day series: exact, with hashed noise, or with whole cycles added; and hashed coherence."""
    px = series(spark, sf_dir).px
    phase, coh = [], []
    for k, p in enumerate(pairs):
        f = displacement_to_phase(disp_at(p.sec) - disp_at(p.ref))
        if noise:
            f = f + noise * ((F.col("row") * 31 + F.col("col") * 17 + k * 7) % 23 - 11).cast("double")
        if jumps:
            f = f + F.when((F.col("row") * 7 + F.col("col") * 3 + k * 13) % 11 == 0, F.lit(6.283185307179586)).otherwise(0.0)
        if one_jump:
            f = f + F.when(((F.col("row") * 7 + F.col("col") * 3) % 4 == 0) & ((F.col("row") + F.col("col")) % len(pairs) == k), F.lit(6.283185307179586)).otherwise(0.0)
        phase.append(f)
        coh.append(coherence(k))
    px = px.select("row", "col", F.array(*phase).alias("phase"), F.array(*coh).alias("coh"))
    return Stack(px, EPOCH_DATES, pairs, (1 << 30, 1 << 30), Meta(wavelength_m=WAVELENGTH_M))


def coherence(k: int) -> Column:
    return 0.3 + 0.6 * ((F.col("row") * 7 + F.col("col") * 13 + k * 29) % 100).cast("double") / 100


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, q, t_yr, disp_m: extended price of each supplier and quarter since 1992."""
    li = table(spark, sf_dir, "lineitem")
    q = ((F.year("l_shipdate") - 1992) * 4 + F.quarter("l_shipdate") - 1).cast("int")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sums = li.select(F.col("l_suppkey").alias("px"), q.alias("q"), cents.alias("cents")).groupBy("px", "q").agg(F.sum("cents").alias("cents"))
    return sums.select("px", "q", (F.col("q") / F.lit(4.0)).alias("t_yr"), (F.col("cents").cast("double") * 1e-8).alias("disp_m"))


# --- the same in SQL ---

K_SQL = "(4 * pi() / 0.05546576)"


def series_sql(name: str = "s", days: int = DAYS, n: int = EPOCHS) -> str:
    return f"""{name} AS (SELECT "row", col, e, e * {days} / 365.25::DOUBLE AS t, cents::DOUBLE * 0.000001::DOUBLE AS d, cents, n FROM (
  SELECT (user_id // 10)::INT AS "row", (user_id % 10)::INT AS col, (date_diff('day', DATE '2024-01-01', ts::DATE) // {days})::INT AS e,
    sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*) AS n FROM events GROUP BY 1, 2, 3) WHERE e BETWEEN 0 AND {n - 1})"""


def stack_sql(noise: float = 0.0, jumps: bool = False, one_jump: bool = False) -> str:
    """s and o("row", col, k, i, j, phase, coh)."""
    f = f"-{K_SQL} * (b.d - a.d)"
    if noise:
        f += f" + {noise}::DOUBLE * ((a.\"row\" * 31 + a.col * 17 + k * 7) % 23 - 11)"
    if jumps:
        f += ' + CASE WHEN (a."row" * 7 + a.col * 3 + k * 13) % 11 = 0 THEN 2 * pi() ELSE 0 END'
    if one_jump:
        f += f' + CASE WHEN (a."row" * 7 + a.col * 3) % 4 = 0 AND (a."row" + a.col) % {len(ALL_PAIRS)} = k THEN 2 * pi() ELSE 0 END'
    rows = ", ".join(f"({k}, {p.ref}, {p.sec})" for k, p in enumerate(ALL_PAIRS))
    return f"""{series_sql()}, p(k, i, j) AS (VALUES {rows}),
full_px AS (SELECT "row", col FROM s GROUP BY 1, 2 HAVING count(*) = {EPOCHS}),
o AS (SELECT a."row", a.col, k, i, j, {f} AS phase, 0.3 + 0.6 * ((a."row" * 7 + a.col * 13 + k * 29) % 100)::DOUBLE / 100 AS coh
  FROM s a JOIN p ON a.e = p.i JOIN s b ON b.e = p.j AND b."row" = a."row" AND b.col = a.col)"""
