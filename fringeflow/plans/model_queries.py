"""More registered queries: inversions, models and corrections whose answer has a closed form, each with that form as SQL."""

from __future__ import annotations

import math
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.functions import phase as P
from fringeflow.operators import features as FE
from fringeflow.operators import filters, inversion, network, troposphere, unwrapping
from fringeflow.operators.cube import Pair, Series, Stack, every, to_long
from fringeflow.plans import fixtures as X
from fringeflow.plans.queries import _PX, _XY, _pixels, query, r, rs

N = X.EPOCHS
_FULL = f'full_px AS (SELECT "row", col FROM s GROUP BY 1, 2 HAVING count(*) = {N})'


def _long(series: Series, digits: int = 6, name: str = "disp_m") -> DataFrame:
    long = to_long(series.px, "epoch_idx", name, "disp").where(F.col(name).isNotNull())
    return long.select("row", "col", "epoch_idx", r(F.col(name), digits).alias(name))


# --- networks ---

_DAYS = f"{X.series_sql('s', 1, X.DAILY)}, e AS (SELECT DISTINCT e FROM s)"


@query(f"""WITH RECURSIVE {_DAYS}, p AS (SELECT x.e AS i, y.e AS j FROM e x JOIN e y ON y.e = x.e + 1),
g(a, b) AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p), h(epoch_idx) AS (SELECT min(i) FROM p UNION SELECT g.b FROM h JOIN g ON g.a = h.epoch_idx) SELECT epoch_idx FROM h""")
def reachable_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of daily epochs: as many hops as there are days."""
    e = X.long_series(spark, sf_dir, 1, X.DAILY).select("epoch_idx").distinct()
    days = e.select("epoch_idx", F.date_add(F.lit(X.FIRST), F.col("epoch_idx")).alias("epoch"), F.lit(0.0).alias("perp_m"))
    return network.reachable(network.pairs_within(days, 1, 1.0))


# --- inversion ---

_B = f"v AS (SELECT \"row\", col, k, i, j, -phase / {X.K_SQL} AS b FROM o SEMI JOIN full_px USING (\"row\", col))"
_DIVERGENCE = "f AS (SELECT \"row\", col, i AS e, -b AS b FROM {0} UNION ALL SELECT \"row\", col, j, b FROM {0}), t AS (SELECT \"row\", col, e, sum(b) AS x FROM f GROUP BY 1, 2, 3)"


# over a complete network without the pair (u, v) the series is f/n + (e_u - e_v) (f_u - f_v) / (n (n - 2)), f: what comes in less what goes out
@query(f"""WITH {X.stack_sql(noise=0.02)}, {_B}, m AS (SELECT * FROM v WHERE (v."row" * 7 + v.col * 3) % 15 <> k), {_DIVERGENCE.format('m')},
g AS (SELECT "row", col, i AS u, j AS w FROM v WHERE ("row" * 7 + col * 3) % 15 = k),
y AS (SELECT t."row", t.col, t.e, t.x / {N} + (CASE WHEN t.e = g.u THEN 1 WHEN t.e = g.w THEN -1 ELSE 0 END) * (a.x - b.x) / ({N} * ({N} - 2)) AS x
  FROM t JOIN g USING ("row", col) JOIN t a ON a."row" = t."row" AND a.col = t.col AND a.e = g.u JOIN t b ON b."row" = t."row" AND b.col = t.col AND b.e = g.w)
SELECT y."row", y.col, y.e AS epoch_idx, {rs('y.x - z.x', 'disp_m')} FROM y JOIN y z ON z."row" = y."row" AND z.col = y.col AND z.e = 0""")
def gappy_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy phases of a complete network; each pixel lacks one pair, fifteen validity patterns in all."""
    s = X.stack(spark, sf_dir, noise=0.02)
    lost = (F.col("row") * 7 + F.col("col") * 3) % 15
    px = s.px.where(~F.exists("phase", lambda x: x.isNull()))
    px = px.withColumn("phase", F.transform("phase", lambda x, k: F.when(k != lost, x)))
    return _long(inversion.invert(s.with_px(px)))


_DROPPED = '("row" * 5 + col * 3 + k * 11) % 7 < 4'


@query(f"""WITH RECURSIVE {X.stack_sql()}, m AS (SELECT "row", col, i, j FROM o SEMI JOIN full_px USING ("row", col) WHERE NOT ({_DROPPED})),
g(r, c, a, b) AS (SELECT "row", col, i, j FROM m UNION ALL SELECT "row", col, j, i FROM m),
h(r, c, e) AS (SELECT "row", col, 0 FROM full_px UNION SELECT g.r, g.c, g.b FROM h JOIN g ON g.r = h.r AND g.c = h.c AND g.a = h.e),
ok AS (SELECT h.r, h.c FROM h GROUP BY 1, 2 HAVING count(*) = {N} AND (SELECT count(*) FROM m WHERE m."row" = h.r AND m.col = h.c) >= {N - 1})
SELECT s."row", s.col, s.e AS epoch_idx, {rs('s.d - z.d', 'disp_m')} FROM s JOIN ok ON ok.r = s."row" AND ok.c = s.col JOIN s z ON z."row" = s."row" AND z.col = s.col AND z.e = 0""")
def gappy_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phases, most pairs of a pixel missing: where the rest connects all epochs the series comes back, elsewhere nothing does."""
    s = X.stack(spark, sf_dir)
    px = s.px.where(~F.exists("phase", lambda x: x.isNull()))
    px = px.withColumn("phase", F.transform("phase", lambda x, k: F.when((F.col("row") * 5 + F.col("col") * 3 + k * 11) % 7 >= 4, x)))
    return _long(inversion.invert(s.with_px(px)))


_DEM_PAIRS = tuple(replace(p, perp_baseline_m=float((k * 37) % 101 - 50)) for k, p in enumerate(X.ALL_PAIRS))


# the height error by the part of its column, and of the data, that no series explains; then the series of what is left
@query(f"""WITH {X.stack_sql(noise=0.02)}, q AS (SELECT k, i, j, -((k * 37) % 101 - 50) / (850000 * sin(radians(39))) AS g FROM p),
gd AS (SELECT e, sum(g) AS x FROM (SELECT i AS e, -g AS g FROM q UNION ALL SELECT j, g FROM q) GROUP BY 1),
gt AS (SELECT k, q.i, q.j, g, g - (b.x - a.x) / {N} AS own FROM q JOIN gd a ON a.e = i JOIN gd b ON b.e = j), {_B},
h AS (SELECT "row", col, sum(own * b) / sum(own * own) AS z FROM v JOIN gt USING (k) GROUP BY 1, 2),
c AS (SELECT v."row", v.col, v.i, v.j, b - g * z AS b, z FROM v JOIN gt USING (k) JOIN h ON h."row" = v."row" AND h.col = v.col), {_DIVERGENCE.format('c')}
SELECT t."row", t.col, t.e AS epoch_idx, {rs(f'(t.x - w.x) / {N}', 'disp_m')}, {rs('z', 'dem_error_m', 4)} FROM t JOIN t w ON w."row" = t."row" AND w.col = t.col AND w.e = 0 JOIN h ON h."row" = t."row" AND h.col = t.col""")
def dem_error_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and height error together, over baselines that no choice of positions explains."""
    s = X.stack(spark, sf_dir, _DEM_PAIRS, noise=0.02)
    got = inversion.invert(s, dem_range_m=850e3).px.where("dem_error_m is not null")
    long = got.select("row", "col", "dem_error_m", F.posexplode("disp").alias("epoch_idx", "disp_m"))
    return long.select("row", "col", "epoch_idx", r(F.col("disp_m")).alias("disp_m"), r(F.col("dem_error_m"), 4).alias("dem_error_m"))


_WHOLE_CM = "round(floor(cents / 10000.0) / 100, 3)"


@query(f"WITH {X.series_sql()}, {_FULL}, c AS (SELECT \"row\", col, e, {_WHOLE_CM} AS d FROM s SEMI JOIN full_px USING (\"row\", col)) SELECT c.\"row\", c.col, c.e AS epoch_idx, {rs('c.d - z.d', 'disp_m', 3)} FROM c JOIN c z ON z.\"row\" = c.\"row\" AND z.col = c.col AND z.e = 0")
def robust_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair of each pixel is a whole cycle off: least absolute residuals find the series as if it were not."""
    long = X.long_series(spark, sf_dir).withColumn("disp_m", F.round(F.floor(F.col("cents") / 10000.0) / 100, 3))
    from fringeflow.operators.cube import to_pixels

    px = to_pixels(long, "epoch_idx", N, disp="disp_m")
    out = (F.col("row") + F.col("col")) % len(X.ALL_PAIRS)
    phase = [P.displacement_to_phase(X.disp_at(p.sec) - X.disp_at(p.ref)) + F.when(out == k, F.lit(6.283185307179586)).otherwise(0.0) for k, p in enumerate(X.ALL_PAIRS)]
    stack = Stack(px.select("row", "col", F.array(*phase).alias("phase")), X.EPOCH_DATES, X.ALL_PAIRS, (1 << 30, 1 << 30))
    return _long(inversion.invert(stack, robust=True), 3)


@query(f"WITH {X.stack_sql()} SELECT \"row\", col, (\"row\" * 7 + col * 3) % 4 = 0 AS corrected, false AS detected FROM full_px")
def closure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pixels had a whole cycle taken away, and which have one left."""
    stack = X.stack(spark, sf_dir, one_jump=True)
    _, flags = inversion.correct_closure(stack.with_px(stack.px.where(~F.exists("phase", lambda x: x.isNull()))))
    return flags


# the least-norm cycles of a single triangle are a third each, which rounds to none
@query(f"""WITH {X.series_sql()}, t AS (SELECT "row", col FROM s WHERE e < 3 GROUP BY 1, 2 HAVING count(*) = 3), c AS (SELECT "row", col, ("row" + col) % 3 AS jumps FROM t)
SELECT "row", col, false AS corrected, jumps > 0 AS detected FROM c""")
def closure_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single triangle that is a cycle off: no pair takes the blame, the error stays and is flagged."""
    pairs = (Pair(0, 1), Pair(1, 2), Pair(0, 2))
    s = X.stack(spark, sf_dir, pairs)
    off = F.when((F.col("row") + F.col("col")) % 3 > 0, 6.283185307179586).otherwise(0.0)
    px = s.px.where(~F.exists("phase", lambda x: x.isNull())).select("row", "col", F.transform("phase", lambda x, k: x + F.when(k == 0, off).otherwise(0.0)).alias("phase"))
    return inversion.correct_closure(Stack(px, X.EPOCH_DATES[:3], pairs, s.shape, s.meta))[1]


# --- models in time ---

_STEP = f"""{X.series_sql('s', 1, X.DAILY)}, m AS (SELECT "row", col, count(*) AS n, avg(t) AS mt, avg(q) AS mq, avg(d) AS md, var_pop(t) AS tt, var_pop(q) AS qq, covar_pop(t, q) AS tq, covar_pop(t, d) AS td, covar_pop(q, d) AS qd
  FROM (SELECT *, {{q}} AS q FROM s) GROUP BY 1, 2 HAVING {{enough}}),
b AS (SELECT *, (qq * td - tq * qd) / (tt * qq - tq * tq) AS b, (tt * qd - tq * td) / (tt * qq - tq * tq) AS c FROM m),
z AS (SELECT s."row", s.col, sum((d - md - b * (t - mt) - c * ({{q}} - mq)) ** 2) AS ssr, sum((d - md) ** 2) AS tot, max_by(d, e) - min_by(d, e) AS cumulative FROM s JOIN b ON b."row" = s."row" AND b.col = s.col GROUP BY 1, 2),
y AS (SELECT b.*, ssr, tot, cumulative, sqrt(ssr / (n - 3) * qq / (n * (tt * qq - tq * tq))) AS std FROM b JOIN z USING ("row", col))"""


@query(f"""WITH {_STEP.format(q='(CASE WHEN e >= 12 THEN 1.0 ELSE 0.0 END)::DOUBLE', enough=f'count(*) = {X.DAILY}')} SELECT "row", col, {rs('b', 'velocity', 4)}, {rs('std', 'velocity_std', 4)}, {rs('md - b * mt - c * mq', 'offset_m', 5)}, {rs('c', 'step_m', 5)} FROM y""")
def temporal_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset, velocity and a step on the thirteenth day."""
    got, names = inversion.fit_temporal_model(X.series(spark, sf_dir, 1, X.DAILY), 1, (), (X.FIRST + timedelta(days=12),))
    at = {c: F.col("coefficients")[k] for k, c in enumerate(names)}
    step = next(c for c in names if c.startswith("step_"))
    got = got.where("velocity is not null")
    return got.select("row", "col", r(F.col("velocity"), 4).alias("velocity"), r(F.col("velocity_std"), 4).alias("velocity_std"), r(at["offset"], 5).alias("offset_m"), r(at[step], 5).alias("step_m"))


_CURVED = FE.FeatureConfig(acceleration=True, seasonal=False)


@query(f"""WITH {_STEP.format(q='t * t', enough='count(*) >= 5')} SELECT "row", col, {rs('b', 'velocity', 3)}, {rs('std', 'velocity_std', 3)}, {rs('2 * c', 'acceleration', 1)},
{rs('greatest(0, least(1, 1 - ssr / tot))', 'linearity_r2', 5)}, {rs('sqrt(ssr / n)', 'residual_rms', 5)}, {rs('cumulative', 'cumulative', 6)} FROM y""")
def features_curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with an acceleration, of pixels with five epochs or more, whichever they have."""
    got = FE.extract(X.series(spark, sf_dir, 1, X.DAILY), _CURVED).where("velocity_std is not null")
    digits = {"velocity": 3, "velocity_std": 3, "acceleration": 1, "linearity_r2": 5, "residual_rms": 5, "cumulative": 6}
    return got.select("row", "col", *(r(F.col(c), d).alias(c) for c, d in digits.items()))


_M, _GOLD = "18446744073709551616::UHUGEINT", "11400714819323198485::UHUGEINT"


def _mixed(z: str, shift: int, factor: str) -> str:
    return f"((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_M})::UBIGINT"


# SplitMix64: the state goes up by a constant, a number is the state mixed three times
@query(f"""WITH {X.series_sql()}, {_FULL},
u AS (SELECT "row", col, xor(xor(42::UBIGINT, (("row"::UHUGEINT * {_GOLD}) % {_M})::UBIGINT), ((col::UHUGEINT * 13787848793156543929::UHUGEINT) % {_M})::UBIGINT) AS seed FROM full_px),
m AS (SELECT "row", col, k, ((seed::UHUGEINT + (k + 1)::UHUGEINT * {_GOLD}) % {_M})::UBIGINT AS z FROM u, (SELECT unnest(range(0, {100 * N})) AS k)),
a AS (SELECT "row", col, k, {_mixed('z', 30, '13787848793156543929')} AS z FROM m), b AS (SELECT "row", col, k, {_mixed('z', 27, '10723151780598845931')} AS z FROM a),
c AS (SELECT "row", col, k // {N} AS draw, (xor(z, z >> 31) % {N})::INT AS e FROM b),
w AS (SELECT c."row", c.col, draw, regr_slope(d, t) AS v FROM c JOIN s ON s."row" = c."row" AND s.col = c.col AND s.e = c.e GROUP BY 1, 2, 3)
SELECT "row", col, {rs('stddev_samp(v)', 'velocity_std', 5)} FROM w GROUP BY 1, 2 HAVING count(v) >= 2""")
def bootstrap_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread of slopes over 100 resamples of the epochs, draw by draw."""
    got = inversion.velocity_bootstrap(X.series(spark, sf_dir), 100).where("velocity_std is not null")
    return got.select("row", "col", r(F.col("velocity_std"), 5).alias("velocity_std"))


@query(f"""WITH {X.series_sql()}, {_FULL} SELECT a."row", a.col, a.e AS epoch_idx, {rs('a.d - avg(b.d)', 'hp')} FROM s a SEMI JOIN full_px USING ("row", col) JOIN s b ON b."row" = a."row" AND b.col = a.col AND abs(b.e - a.e) <= least(2, a.e, {N - 1} - a.e) GROUP BY a."row", a.col, a.e, a.d""")
def temporal_high_pass_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window 5 over equal steps: the line's value in the middle is the mean."""
    got = filters.high_pass(X.series(spark, sf_dir), 5).withColumnRenamed("hp", "disp")
    return _long(Series(got, X.EPOCH_DATES, (1, 1)), name="hp")


@query(f"""WITH {X.series_sql()}, m AS (SELECT "row", col, regr_slope(d, t) AS b, regr_intercept(d, t) AS a FROM s GROUP BY 1, 2 HAVING count(*) = {N}) SELECT s."row", s.col, e AS epoch_idx, {rs('d - a - b * t', 'hp')} FROM s JOIN m ON m."row" = s."row" AND m.col = s.col""")
def temporal_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window that covers all epochs: what is left of one line through them."""
    got = filters.high_pass(X.series(spark, sf_dir), 2 * N + 1).withColumnRenamed("hp", "disp")
    return _long(Series(got, X.EPOCH_DATES, (1, 1)), name="hp")


# --- corrections over space ---


@query(f"WITH {X.series_sql()}, {_FULL} SELECT s.\"row\", s.col, s.e AS epoch_idx, {rs('(s.\"row\" * 7 + s.col * 3 + s.e) % 2 * 0.0', 'disp_m')} FROM s SEMI JOIN full_px USING (\"row\", col)")
def deramped_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadratic surface of each epoch goes entirely."""
    s = X.series(spark, sf_dir, with_shape=True)
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    surface = F.transform("disp", lambda d, e: d * 0 + 0.02 * e - 0.003 * x + 0.001 * (e + 1) * y + 0.0004 * x * x - 0.00001 * y * y + 0.0002 * e * x * y)
    px = s.px.where(~F.exists("disp", lambda d: d.isNull())).select("row", "col", surface.alias("disp"))
    return _long(filters.deramp(s.with_px(px), "quadratic"))


_H = '(("row" * 37 + col * 11) % 3000)::DOUBLE'


@query(f"""WITH {X.series_sql()}, b AS (SELECT "row", col, e, d, {_H} AS x, {_H} * {_H} AS y FROM s),
n AS (SELECT e, avg(x) AS mx, avg(x * x) AS mxx, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, d) AS xd, covar_pop(y, d) AS yd FROM b GROUP BY e)
SELECT "row", col, b.e AS epoch_idx, {rs('d - (yy * xd - xy * yd) / (xx * yy - xy * xy) * (x - mx) - (xx * yd - xy * xd) / (xx * yy - xy * xy) * (y - mx * mx)', 'disp_m')} FROM b JOIN n ON b.e = n.e""")
def topography_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of height and its square, both counted from the mean height, what goes with them goes."""
    s = X.series(spark, sf_dir)
    s = s.with_px(s.px.withColumn("height_m", ((F.col("row") * 37 + F.col("col") * 11) % 3000).cast("double")))
    return _long(filters.correct_topography(s, 2))


_HEIGHT = "(((\"row\" * 37 + col * 11) % 3000) - 250 + CASE WHEN (\"row\" + col) % 9 = 0 THEN 10500 ELSE 0 END)::DOUBLE"
_WET = "(71.6 - 77.6 * 0.622) * {e} / {t} + 3.75e5 * {e} / ({t} * {t})"


@query(f"""WITH {_PX}, g AS (SELECT "row", col, lat, {_HEIGHT} AS z0, 0.001 * (col + 1) AS q0 FROM px),
f AS (SELECT *, least(greatest(floor(z0 / 1000), 0), 10)::INT AS i, z0 / 1000 - least(greatest(floor(z0 / 1000), 0), 10) AS w FROM g),
h AS (SELECT *, 288.15 - 6.5 * z0 / 1000 AS tk0, 1013.25 * exp(-z0 / 8000) AS p0, q0 * (exp(-i / 2.0) + w * (exp(-(i + 1) / 2.0) - exp(-i / 2.0))) AS qz FROM f),
l AS (SELECT "row", col, z0 AS z, tk0 AS tk, p0 AS pr, qz AS q FROM h UNION ALL SELECT "row", col, n * 1000.0, 288.15 - 6.5 * n, 1013.25 * exp(-n / 8.0), q0 * exp(-n / 2.0) FROM h, (SELECT unnest(range(0, 12)) AS n) WHERE n * 1000.0 > z0 + 1e-9),
x AS (SELECT "row", col, z, {_WET.format(e='(q * pr / (0.622 + (1 - 0.622) * q))', t='tk')} AS v FROM l),
y AS (SELECT "row", col, coalesce((z - lag(z) OVER k) * (v + lag(v) OVER k) / 2, 0) AS a FROM x WINDOW k AS (PARTITION BY "row", col ORDER BY z)), t AS (SELECT "row", col, sum(a) * 1e-6 AS zwd FROM y GROUP BY 1, 2)
SELECT h."row", h.col, {rs('p0', 'pressure_hpa', 5)}, {rs('tk0', 'temperature_k', 5)}, {rs('qz', 'humidity', 8)}, {rs('zwd', 'zwd_m', 8)}, {rs('0.0022768 * p0 / (1 - 0.00266 * cos(2 * radians(lat)) - 0.00028 * z0 / 1000.0) + zwd', 'delay_m', 8)} FROM h JOIN t USING ("row", col)""")
def zenith_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles between their levels, below the lowest and above the highest; wet delay from there up, and the whole delay."""
    level = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct((i * 1000.0).alias("height_m"), (1013.25 * F.exp(-i / 8.0)).alias("pressure_hpa"), (288.15 - 6.5 * i).alias("temperature_k"), (F.col("q") * F.exp(-i / 2.0)).alias("specific_humidity")))
    z = (F.col("h") - 250 + F.when((F.col("row") + F.col("col")) % 9 == 0, 10500).otherwise(0)).cast("double")
    px = _pixels(spark, sf_dir).withColumn("levels", level).withColumn("z", z)
    at = troposphere.interpolate(F.col("levels"), F.col("z"))
    wet, whole = troposphere.zenith_wet(F.col("levels"), F.col("z")), troposphere.zenith_delay(F.col("levels"), F.col("z"), F.col("lat"))
    return px.select("row", "col", r(at["pressure_hpa"], 5).alias("pressure_hpa"), r(at["temperature_k"], 5).alias("temperature_k"), r(at["specific_humidity"], 8).alias("humidity"), r(wet, 8).alias("zwd_m"), r(whole, 8).alias("delay_m"))


# --- unwrapping ---

_TRUE = '(0.45 * "row" + 0.35 * col + 0.01 * k)'
_QUALITY = '(CASE WHEN col = 4 AND "row" > 0 THEN 0.2 ELSE 0.5 + (("row" * 7 + col * 13) % 97) / 250.0 END)'


@query(f"""WITH {X.series_sql()}, g AS (SELECT a.r AS "row", b.c AS col, {_QUALITY.replace('"row"', 'a.r').replace('col', 'b.c')} AS quality FROM {_XY} m, LATERAL (SELECT unnest(range(0, mr + 1)) AS r) a, LATERAL (SELECT unnest(range(0, mc + 1)) AS c) b),
best AS (SELECT "row" AS r0, col AS c0 FROM g WHERE quality >= 0.3 ORDER BY quality DESC, "row", col LIMIT 1)
SELECT "row"::INT AS "row", col::INT AS col, k::INT AS pair_idx, {rs(f'{_TRUE} - 2 * pi() * round((0.45 * r0 + 0.35 * c0 + 0.01 * k) / (2 * pi()))', 'phase')} FROM g, best, (SELECT unnest(range(0, 4)) AS k) WHERE quality >= 0.3""")
def unwrapped_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the best pixel on; a wall of poor ones is not unwrapped, but for the gap that it has."""
    rows, cols = X.shape(X.long_series(spark, sf_dir).select("row", "col"))
    grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    quality = F.when((F.col("col") == 4) & (F.col("row") > 0), 0.2).otherwise(0.5 + (F.col("row") * 7 + F.col("col") * 13) % 97 / 250.0)
    layers = grid.withColumn("quality", quality).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pair_idx"))
    f = 0.45 * F.col("row") + 0.35 * F.col("col") + 0.01 * F.col("pair_idx")
    layers = layers.select("row", "col", "pair_idx", "quality", P.wrapped_phase(F.cos(f), F.sin(f)).alias("wrapped"))
    got = unwrapping.unwrap_stack(layers, (rows, cols), "quality", 0.3).where("phase is not null")
    return got.select("row", "col", "pair_idx", r(F.col("phase")).alias("phase"))


_WALL = 'CASE WHEN g.col = 4 AND g."row" > 0 THEN 0.2 ELSE 0.5 + (coalesce(t.n, 0) % 97) / 250.0 END'


@query(f"""WITH {X.series_sql()}, t AS (SELECT "row", col, sum(cents)::BIGINT AS c, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2),
g AS (SELECT a.r AS "row", b.c AS col FROM {_XY} m, LATERAL (SELECT unnest(range(0, mr + 1)) AS r) a, LATERAL (SELECT unnest(range(0, mc + 1)) AS c) b),
f AS (SELECT g."row", g.col, {_WALL} AS quality, 0.45 * g."row" + 0.35 * g.col + (abs(coalesce(t.c, 0)) % 100) * 0.003 AS f FROM g LEFT JOIN t ON t."row" = g."row" AND t.col = g.col),
best AS (SELECT f AS f0 FROM f WHERE quality >= 0.3 ORDER BY quality DESC, "row", col LIMIT 1)
SELECT "row"::INT AS "row", col::INT AS col, k::INT AS pair_idx, CASE WHEN quality >= 0.3 THEN round(f + 0.01 * k - 2 * pi() * round((f0 + 0.01 * k) / (2 * pi())), 6) + 0.0::DOUBLE END AS phase FROM f, best, (SELECT unnest(range(0, 4)) AS k)""")
def unwrapped_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rough layers and their quality from the table, in tiles of 8 x 8 pixels whose islands are joined along their seams; a wall of poor pixels."""
    long = X.long_series(spark, sf_dir)
    rows, cols = X.shape(long.select("row", "col"))
    grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    px = grid.join(long.groupBy("row", "col").agg(F.sum("cents").alias("c"), F.sum("n").alias("n")), ["row", "col"], "left")
    quality = F.when((F.col("col") == 4) & (F.col("row") > 0), 0.2).otherwise(0.5 + F.coalesce("n", F.lit(0)) % 97 / 250.0)
    f = 0.45 * F.col("row") + 0.35 * F.col("col") + F.abs(F.coalesce("c", F.lit(0))) % 100 * 0.003
    layers = px.select("row", "col", quality.alias("quality"), f.alias("f")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pair_idx"))
    f = F.col("f") + 0.01 * F.col("pair_idx")
    got = unwrapping.unwrap_stack(layers.select("row", "col", "pair_idx", "quality", P.wrapped_phase(F.cos(f), F.sin(f)).alias("wrapped")), (rows, cols), "quality", 0.3, tile=8)
    return got.select("row", "col", "pair_idx", r(F.col("phase")).alias("phase"))


# never two side by side: pixels that spikes alone connect would have no turns of least cost of their own
_SPIKE = '(g."row" % 3 = 1 AND g.col % 3 = 1 AND abs(coalesce(t.c, 0)) % 3 = 0)'


@query(f"""WITH {X.series_sql()}, t AS (SELECT "row", col, sum(cents)::BIGINT AS c, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2),
g AS (SELECT a.r AS "row", b.c AS col FROM {_XY} m, LATERAL (SELECT unnest(range(0, mr + 1)) AS r) a, LATERAL (SELECT unnest(range(0, mc + 1)) AS c) b),
f AS (SELECT g."row", g.col, CASE WHEN {_SPIKE} THEN 0.05 ELSE 0.5 + (coalesce(t.n, 0) % 97) / 250.0 END AS quality, {_SPIKE} AS spike, 0.45 * g."row" + 0.35 * g.col + (abs(coalesce(t.c, 0)) % 100) * 0.003 AS f FROM g LEFT JOIN t ON t."row" = g."row" AND t.col = g.col),
best AS (SELECT f AS f0 FROM f ORDER BY quality DESC, "row", col LIMIT 1)
SELECT "row"::INT AS "row", col::INT AS col, round(f - 2 * pi() * round(f0 / (2 * pi())), 6) + 0.0::DOUBLE AS phase FROM f, best WHERE NOT spike""")
def unwrapped_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of least cost over a layer where single pixels, by the table, are off by three radians and of poor quality: the others come out whole."""
    long = X.long_series(spark, sf_dir)
    rows, cols = X.shape(long.select("row", "col"))
    grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    px = grid.join(long.groupBy("row", "col").agg(F.sum("cents").alias("c"), F.sum("n").alias("n")), ["row", "col"], "left").withColumn("c", F.abs(F.coalesce("c", F.lit(0))))
    spike = (F.col("row") % 3 == 1) & (F.col("col") % 3 == 1) & (F.col("c") % 3 == 0)
    f = 0.45 * F.col("row") + 0.35 * F.col("col") + F.col("c") % 100 * 0.003 + F.when(spike, 3.0).otherwise(0.0)
    layers = px.select("row", "col", F.lit(0).alias("pair_idx"), spike.alias("spike"), F.when(spike, 0.05).otherwise(0.5 + F.coalesce("n", F.lit(0)) % 97 / 250.0).alias("quality"), P.wrapped_phase(F.cos(f), F.sin(f)).alias("wrapped"))
    got = unwrapping.unwrap_stack(layers, (rows, cols), "quality", method="cost")
    return got.join(layers.where(~F.col("spike")).select("row", "col"), ["row", "col"], "left_semi").select("row", "col", r(F.col("phase")).alias("phase"))


# --- series of a known model: its terms come back ---

_TERMS = {"a": "(c % 100) * 1e-4", "b": "(c % 37 - 18) * 1e-3", "q": "(c % 23 - 11) * 1e-3", "s": "(c % 19 + 1) * 1e-3", "w": "(c % 29 - 14) * 1e-3", "j": "(c % 13) * 1e-3"}
_MONTHS, _STEP = 40, 20


def _modelled(spark: SparkSession, sf_dir: str, gaps: bool, jump: bool) -> Series:
    """Forty epochs of a quadratic, a yearly wave and a jump, whose sizes the table's cents give for each pixel."""
    px = X.long_series(spark, sf_dir).groupBy("row", "col").agg(F.abs(F.sum("cents")).alias("c")).select("row", "col", *(F.expr(f"cast({v} as double)").alias(k) for k, v in _TERMS.items()))

    def at(e):
        t = e * 30 / F.lit(365.25)
        d = F.col("a") + F.col("b") * t + F.col("q") * t * t + F.col("s") * F.sin(2 * math.pi * t) + F.col("w") * F.cos(2 * math.pi * t)
        d = d + F.when(e >= _STEP, F.col("j")).otherwise(0.0) if jump else d
        return F.when((F.col("row") * 7 + F.col("col") * 3 + e) % 11 != 0, d) if gaps else d

    return Series(px.select("row", "col", F.transform(F.sequence(F.lit(0), F.lit(_MONTHS - 1)), at).alias("disp")), every(X.FIRST, 30, _MONTHS), (1 << 30, 1 << 30))


_MODELLED = f"""{X.series_sql()}, t AS (SELECT "row", col, abs(sum(cents))::BIGINT AS c FROM s GROUP BY 1, 2), m AS (SELECT "row", col, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _TERMS.items())} FROM t)"""


@query(f"""WITH {_MODELLED}, x AS (SELECT m.*, e, a + b * (e * 30 / 365.25) + q * (e * 30 / 365.25) ** 2 + s * sin(2 * pi() * e * 30 / 365.25) + w * cos(2 * pi() * e * 30 / 365.25) AS d FROM m, (SELECT unnest(range(0, {_MONTHS})) AS e) WHERE ("row" * 7 + col * 3 + e) % 11 <> 0),
y AS (SELECT *, abs(d - lag(d) OVER (PARTITION BY "row", col ORDER BY e)) AS step FROM x)
SELECT "row", col, {rs('any_value(b)', 'velocity')}, 0.0::DOUBLE AS velocity_std, {rs('2 * any_value(q)', 'acceleration')}, 1.0::DOUBLE AS linearity_r2, 0.0::DOUBLE AS residual_rms, {rs('max_by(d, e) - min_by(d, e)', 'cumulative')},
  {rs('any_value(sqrt(s * s + w * w))', 'seasonal_amplitude')}, {rs('any_value(atan2(w, s))', 'seasonal_phase')}, {rs('max(step)', 'max_step')} FROM y GROUP BY 1, 2""")
def features_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceleration, yearly wave and all other features of series with gaps that a quadratic and a wave make up exactly."""
    got = FE.extract(_modelled(spark, sf_dir, True, False))
    return got.select("row", "col", *(r(F.col(c)).alias(c) for c in FE.names(FE.FeatureConfig())))


@query(f"""WITH {_MODELLED}, n AS (SELECT "row", col, unnest(['offset', 'velocity', 'poly_2', 'cos_1yr', 'sin_1yr', 'step']) AS term, unnest([a, b, q, w, s, j]) AS v FROM m) SELECT "row", col, term, {rs('v', 'coefficient')} FROM n""")
def temporal_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadratic, a yearly wave and a step, fitted to series that they make up exactly."""
    series = _modelled(spark, sf_dir, False, True)
    got, names = inversion.fit_temporal_model(series, 2, (1.0,), (series.epochs[_STEP],))
    short = F.create_map(*[x for n in names for x in (F.lit(n), F.lit("step" if n.startswith("step") else n if n in ("offset", "velocity", "cos_1yr", "sin_1yr") else "poly_2"))])
    terms = got.select("row", "col", F.posexplode("coefficients").alias("k", "v"))
    return terms.select("row", "col", short[F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)].alias("term"), r(F.col("v")).alias("coefficient"))
