"""The registered queries of the library, over cubes derived from the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fringeflow.functions import phase as P
from fringeflow.operators import decompose as D
from fringeflow.operators import features as FE
from fringeflow.operators import filters, inversion, network, ps, troposphere, unwrapping
from fringeflow.operators.cube import Pair, Series, Stack, to_long, to_pixels
from fringeflow.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Digits that results are rounded to.
R = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: Column, digits: int = R) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def rs(x: str, name: str, digits: int = R) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE AS {name}"


# --- networks ---

_E = f"{X.series_sql()}, e AS (SELECT DISTINCT e, DATE '2024-01-01' + e * {X.DAYS} AS day, ((e * 37) % 101 - 50)::DOUBLE AS b FROM s)"
_NEAR = "x.e < y.e AND abs(y.day - x.day) <= {days} AND abs(y.b - x.b) <= {base}"


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.long_series(spark, sf_dir).select("epoch_idx").distinct()
    day = F.date_add(F.lit(X.FIRST), F.col("epoch_idx") * X.DAYS)
    return e.select("epoch_idx", day.alias("epoch"), ((F.col("epoch_idx") * 37) % 101 - 50).cast("double").alias("perp_m"))


@query(f"WITH {_E} SELECT x.e AS ref_idx, y.e AS sec_idx, y.b - x.b AS perp_baseline_m, (y.day::DATE - x.day::DATE)::INT AS dt_days FROM e x JOIN e y ON {_NEAR.format(days=12, base=60)}")
def pair_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.pairs_within(_epochs(spark, sf_dir), 12, 60.0)


def _numbered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("pair_idx", (F.row_number().over(Window.orderBy("ref_idx", "sec_idx")) - 1).cast("int"))


@query(f"""WITH {_E}, p AS (SELECT x.e AS i, y.e AS j, (row_number() OVER (ORDER BY x.e, y.e) - 1)::INT AS k FROM e x JOIN e y ON {_NEAR.format(days=20, base=60)})
SELECT ab.i AS a, ab.j AS b, bc.j AS c, ab.k AS ab, bc.k AS bc, ac.k AS ac FROM p ab JOIN p bc ON ab.j = bc.i JOIN p ac ON ac.i = ab.i AND ac.j = bc.j""")
def closure_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.closure_loops(_numbered(network.pairs_within(_epochs(spark, sf_dir), 20, 60.0)))


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT x.e AS i, y.e AS j FROM e x JOIN e y ON {_NEAR.format(days=5, base=200)}),
g(a, b) AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p), h(epoch_idx) AS (SELECT min(i) FROM p UNION SELECT g.b FROM h JOIN g ON g.a = h.epoch_idx) SELECT epoch_idx FROM h""")
def reachable_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.reachable(network.pairs_within(_epochs(spark, sf_dir), 5, 200.0))


@query(f"WITH {_E}, p AS (SELECT x.e AS i, y.e AS j, (row_number() OVER (ORDER BY x.e, y.e) - 1)::INT AS k FROM e x JOIN e y ON {_NEAR.format(days=12, base=60)}) SELECT k AS pair_idx, m.m::INT AS increment FROM p, LATERAL (SELECT unnest(range(i, j)) AS m) m")
def design_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.design_rows(_numbered(network.pairs_within(_epochs(spark, sf_dir), 12, 60.0)), X.EPOCHS)


@query(f"WITH {_E} SELECT x.e AS ref_idx, y.e AS sec_idx, {rs('-(y.b - x.b) / (850000 * sin(radians(39)))', 'metres', 9)} FROM e x JOIN e y ON x.e < y.e")
def dem_error_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = inversion.dem_error_column(X.ALL_PAIRS, 850e3, 39.0)
    rows = [(p.ref, p.sec, float(x)) for p, x in zip(X.ALL_PAIRS, g, strict=True)]
    return spark.createDataFrame(rows, "ref_idx int, sec_idx int, metres double").select("ref_idx", "sec_idx", r(F.col("metres"), 9).alias("metres"))


# --- columns ---


@query(f"""WITH {X.stack_sql()} SELECT "row", col, k AS pair_idx, {rs('phase', 'phase')}, {rs(f'-phase / {X.K_SQL}', 'disp_m')},
{rs('atan2(sin(phase), cos(phase))', 'wrapped')}, {rs('phase - 2 * pi() * ceil((phase - pi()) / (2 * pi()))', 'within')} FROM o""")
def pair_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = X.stack(spark, sf_dir).px
    f = F.col("phase")
    long = to_long(px, "pair_idx", "phase", "phase").where("phase is not null")
    return long.select("row", "col", "pair_idx", r(f).alias("phase"), r(P.phase_to_displacement(f)).alias("disp_m"), r(P.wrapped_phase(F.cos(f), F.sin(f))).alias("wrapped"), r(P.wrap_diff(f)).alias("within"))


_W = "least(greatest(coh, 0.01), 0.99)"


@query(f"""WITH {X.stack_sql()} SELECT "row", col, k AS pair_idx, {rs(_W, 'w_coherence')}, {rs(f'2 * {_W} * {_W} / (1 - {_W} * {_W})', 'w_variance')}, coh >= 0.6 AS kept FROM o WHERE "row" BETWEEN 1 AND 7 AND col BETWEEN 2 AND 99""")
def coherence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = X.stack(spark, sf_dir).px.where(F.exists("phase", lambda x: x.isNotNull()))
    px = px.select("row", "col", F.posexplode(F.arrays_zip("phase", "coh")).alias("pair_idx", "x")).where("x.phase is not null").where(P.in_region(F.col("row"), F.col("col"), (1, 2, 7, 99)))
    g = F.col("x.coh")
    return px.select("row", "col", "pair_idx", r(P.coherence_weight(g, "coherence")).alias("w_coherence"), r(P.coherence_weight(g)).alias("w_variance"), P.coherence_mask(g, 0.6).alias("kept"))


@query(f"""WITH {X.stack_sql()} SELECT "row", col, k AS pair_idx, {rs(_W, 'w_coherence')}, {rs(f'2 * {_W} * {_W} / (1 - {_W} * {_W})', 'w_variance')}, coh >= 0.6 AS kept, "row" BETWEEN 1 AND 7 AND col BETWEEN 2 AND 99 AS in_region FROM o""")
def coherence_weights_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coherence_weights over every pixel, with its region as a flag."""
    px = X.stack(spark, sf_dir).px.where(F.exists("phase", lambda x: x.isNotNull()))
    px = px.select("row", "col", F.posexplode(F.arrays_zip("phase", "coh")).alias("pair_idx", "x")).where("x.phase is not null")
    g = F.col("x.coh")
    weights = (r(P.coherence_weight(g, "coherence")).alias("w_coherence"), r(P.coherence_weight(g)).alias("w_variance"), P.coherence_mask(g, 0.6).alias("kept"))
    return px.select("row", "col", "pair_idx", *weights, P.in_region(F.col("row"), F.col("col"), (1, 2, 7, 99)).alias("in_region"))


_PX = f"{X.series_sql()}, px AS (SELECT DISTINCT \"row\", col, 30 + (\"row\" * 7 + col * 3) % 15 AS inc, 90 - (100 + (\"row\" + col) % 5) AS head, 900.0 + \"row\" % 100 AS p, 0.001 * (col + 1) AS q, 10 + \"row\" % 60 AS lat, (\"row\" * 37 + col * 11) % 3000 AS h FROM s)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = F.col("row"), F.col("col")
    px = X.long_series(spark, sf_dir).select("row", "col").distinct()
    return px.select("row", "col", (30 + (row * 7 + col * 3) % 15).alias("inc"), P.azimuth_to_heading(100 + (row + col) % 5).alias("head"), (900.0 + row % 100).alias("p"), (0.001 * (col + 1)).alias("q"), (10 + row % 60).alias("lat"), ((row * 37 + col * 11) % 3000).alias("h"))


@query(f"""WITH {_PX} SELECT "row", col, {rs('-sin(radians(inc)) * cos(radians(head))', 'east', 9)}, {rs('sin(radians(inc)) * sin(radians(head))', 'north', 9)}, {rs('cos(radians(inc))', 'up', 9)},
{rs('4000.0 + (col + 0.5) * 30', 'x')}, {rs('9000.0 - ("row" + 0.5) * 30', 'y')} FROM px""")
def los_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.los_vector(F.col("inc"), F.col("head"))
    x, y = P.pixel_to_geo(F.col("row"), F.col("col"), (4000.0, 9000.0, 30.0, -30.0))
    return _pixels(spark, sf_dir).select("row", "col", r(v["east"], 9).alias("east"), r(v["north"], 9).alias("north"), r(v["up"], 9).alias("up"), r(x).alias("x"), r(y).alias("y"))


_ZHD = "0.0022768 * p / (1 - 0.00266 * cos(2 * radians(lat)) - 0.00028 * h / 1000.0)"


@query(f"WITH {_PX} SELECT \"row\", col, {rs('q * p / (0.622 + (1 - 0.622) * q)', 'vapour_hpa')}, {rs(_ZHD, 'zhd_m', 9)}, {rs(f'{_ZHD} / cos(radians(inc))', 'los_m', 9)} FROM px")
def atmospheric_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    zhd = P.saastamoinen_zhd(F.col("p"), F.col("lat"), F.col("h"))
    return _pixels(spark, sf_dir).select("row", "col", r(P.vapor_pressure(F.col("q"), F.col("p"))).alias("vapour_hpa"), r(zhd, 9).alias("zhd_m"), r(P.project_to_los(zhd, F.col("inc")), 9).alias("los_m"))


# --- aggregates ---

_DISP = f"{X.series_sql()}, d AS (SELECT \"row\", col, CASE WHEN count(*) = {X.EPOCHS} AND abs(avg(cents::DOUBLE)) > 1.1920929e-7 THEN stddev_samp(cents::DOUBLE) / avg(cents::DOUBLE) END AS v FROM s GROUP BY 1, 2)"


def _dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    amp = X.long_series(spark, sf_dir).select("row", "col", "epoch_idx", F.col("cents").cast("double").alias("amplitude"))
    return ps.amplitude_dispersion(amp, X.EPOCHS)


@query(f"WITH {_DISP} SELECT \"row\", col, {rs('v', 'amp_dispersion')} FROM d")
def amplitude_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispersion(spark, sf_dir).select("row", "col", r(F.col("amp_dispersion")).alias("amp_dispersion"))


@query(f"WITH {_DISP} SELECT \"row\", col, {rs('v', 'amp_dispersion')} FROM d WHERE v <= 0.4")
def persistent_scatterers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.select_ps(_dispersion(spark, sf_dir)).select("row", "col", r(F.col("amp_dispersion")).alias("amp_dispersion"))


@query(f"""WITH {X.series_sql('s', 1, X.DAILY)}, g AS (SELECT "row", col, count(*) AS n, avg(0.3 + 0.6 * (("row" * 7 + col * 13 + e * 29) % 100)::DOUBLE / 100)::FLOAT AS m FROM s WHERE "row" BETWEEN 0 AND 9 GROUP BY 1, 2)
SELECT "row", col FROM g ORDER BY n DESC, m DESC, "row", col LIMIT 1""")
def reference_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    coh = X.long_series(spark, sf_dir, 1, X.DAILY).select("row", "col", (0.3 + 0.6 * ((F.col("row") * 7 + F.col("col") * 13 + F.col("epoch_idx") * 29) % 100).cast("double") / 100).alias("coh"))
    return spark.createDataFrame([inversion.select_reference_pixel(coh, (0, 0, 9, 9))], "row int, col int")


@query(f"""WITH {X.series_sql('s', 1, X.DAILY)}, g AS (SELECT "row", col, count(*) AS n, avg(0.3 + 0.6 * (("row" * 7 + col * 13 + e * 29) % 100)::DOUBLE / 100)::FLOAT AS m FROM s GROUP BY 1, 2)
SELECT "row", col FROM g ORDER BY n DESC, m DESC, "row", col LIMIT 1""")
def reference_pixel_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference among all pixels."""
    coh = X.long_series(spark, sf_dir, 1, X.DAILY).select("row", "col", (0.3 + 0.6 * ((F.col("row") * 7 + F.col("col") * 13 + F.col("epoch_idx") * 29) % 100).cast("double") / 100).alias("coh"))
    got = inversion.select_reference_pixel(coh)
    return spark.createDataFrame([got] if got else [], "row int, col int")


_LOOPS = "l AS (SELECT ab.k AS ab, bc.k AS bc, ac.k AS ac FROM p ab JOIN p bc ON ab.j = bc.i JOIN p ac ON ac.i = ab.i AND ac.j = bc.j)"


@query(f"""WITH {X.stack_sql(jumps=True)}, {_LOOPS} SELECT x."row", x.col, sum(CASE WHEN round((x.phase + y.phase - z.phase) / (2 * pi())) <> 0 THEN 1 ELSE 0 END)::DOUBLE AS closures
FROM l JOIN o x ON x.k = l.ab JOIN o y ON y.k = l.bc AND y."row" = x."row" AND y.col = x.col JOIN o z ON z.k = l.ac AND z."row" = x."row" AND z.col = x.col GROUP BY 1, 2""")
def nonzero_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inversion.nonzero_closures(X.stack(spark, sf_dir, jumps=True)).where("closures is not null")


@query(f"""WITH {X.stack_sql(noise=0.02)}, q AS (SELECT o."row", o.col, phase + {X.K_SQL} * (b.d - a.d) AS x FROM o JOIN s a ON a."row" = o."row" AND a.col = o.col AND a.e = o.i JOIN s b ON b."row" = o."row" AND b.col = o.col AND b.e = o.j)
SELECT "row", col, {rs('sqrt(sum(cos(x)) ** 2 + sum(sin(x)) ** 2) / count(*)', 'temporal_coherence')} FROM q GROUP BY 1, 2""")
def temporal_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = inversion.temporal_coherence(X.stack(spark, sf_dir, noise=0.02), X.series(spark, sf_dir))
    return got.where("temporal_coherence is not null").select("row", "col", r(F.col("temporal_coherence")).alias("temporal_coherence"))


_SLOPE = f"CASE WHEN count(*) = {X.EPOCHS} THEN regr_slope(d, t) END"


@query(f"WITH {X.series_sql()} SELECT \"row\", col, {rs(_SLOPE, 'velocity')} FROM s GROUP BY 1, 2")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inversion.velocity(X.series(spark, sf_dir)).select("row", "col", r(F.col("velocity")).alias("velocity"))


@query(f"WITH {X.series_sql()} SELECT \"row\", col, {rs(_SLOPE, 'velocity')} FROM s GROUP BY 1, 2")
def velocity_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inversion.velocity_long(X.long_series(spark, sf_dir), X.EPOCHS).select("row", "col", r(F.col("velocity")).alias("velocity"))


@query("""WITH q AS (SELECT l_suppkey AS px, ((year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) - 1)::INT AS q, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT::DOUBLE * 1e-8::DOUBLE AS d FROM lineitem GROUP BY 1, 2)
SELECT px, round(regr_slope(d, q / 4.0::DOUBLE), 6) + 0.0::DOUBLE AS velocity, count(*) AS n FROM q GROUP BY 1""")
def velocity_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.quarters(spark, sf_dir).groupBy("px").agg(r(F.regr_slope("disp_m", "t_yr")).alias("velocity"), F.count("*").alias("n"))


_MODEL = f"m AS (SELECT \"row\", col, regr_slope(d, t) AS b, regr_intercept(d, t) AS a, avg(t) AS tm, count(*) AS n FROM s GROUP BY 1, 2)"


@query(f"""WITH {X.series_sql()}, {_MODEL} SELECT s."row", s.col, {rs(f'CASE WHEN max(m.n) = {X.EPOCHS} THEN sqrt(sum((d - a - b * t) ** 2) / (max(m.n) - 2) / sum((t - tm) ** 2)) END', 'velocity_std')}
FROM s JOIN m ON s."row" = m."row" AND s.col = m.col GROUP BY 1, 2""")
def velocity_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inversion.velocity_uncertainty(X.series(spark, sf_dir)).select("row", "col", r(F.col("velocity_std")).alias("velocity_std"))


@query()
def velocity_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inversion.velocity_bootstrap(X.series(spark, sf_dir), 100)


@query()
def temporal_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.series(spark, sf_dir, 1, X.DAILY)
    return inversion.fit_temporal_model(s, 2, (0.5,), (X.FIRST + timedelta(days=12),))[0]


# --- inversion ---

# over a complete network the least-squares series is the difference of what comes in at an epoch and at the first, over n
_REFERENCED = f"""z AS (SELECT k, phase FROM o WHERE "row" = 0 AND col = 0),
v AS (SELECT o."row", o.col, i, j, -(o.phase - z.phase) / {X.K_SQL} AS b FROM o JOIN z USING (k)),
f AS (SELECT "row", col, i AS e, -b AS b FROM v UNION ALL SELECT "row", col, j, b FROM v),
t AS (SELECT "row", col, e, sum(b) / {X.EPOCHS} AS x FROM f SEMI JOIN full_px USING ("row", col) GROUP BY 1, 2, 3),
y AS (SELECT t."row", t.col, t.e, t.x - w.x AS d, t.e * {X.DAYS} / 365.25::DOUBLE AS yr FROM t JOIN t w ON w."row" = t."row" AND w.col = t.col AND w.e = 0)"""


def _inverted(spark: SparkSession, sf_dir: str) -> Series:
    stack, _ = inversion.reference_to_pixel(X.stack(spark, sf_dir, noise=0.02), 0, 0)
    return inversion.invert(stack)


@query(f"WITH {X.stack_sql(noise=0.02)}, {_REFERENCED} SELECT \"row\", col, e AS epoch_idx, {rs('d', 'disp_m', 7)} FROM y")
def sbas_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = to_long(_inverted(spark, sf_dir).px, "epoch_idx", "disp_m", "disp").where("disp_m is not null")
    return long.select("row", "col", "epoch_idx", r(F.col("disp_m"), 7).alias("disp_m"))


@query(f"WITH {X.stack_sql(noise=0.02)}, {_REFERENCED} SELECT \"row\", col, {rs('regr_slope(d, yr)', 'velocity')} FROM y GROUP BY 1, 2")
def sbas_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inversion.velocity(_inverted(spark, sf_dir)).where("velocity is not null").select("row", "col", r(F.col("velocity")).alias("velocity"))


_TRIANGLE = (Pair(0, 1), Pair(1, 2), Pair(0, 2))
_G = f"least(greatest(0.3 + 0.6 * ((\"row\" * 7 + col * 13 + k * 29) % 100)::DOUBLE / 100, 0.01), 0.99)"


@query(f"""WITH {X.series_sql()}, p(k, i, j) AS (VALUES (0, 0, 1), (1, 1, 2), (2, 0, 2)),
o AS (SELECT a."row", a.col, k, (b.d - a.d) - 0.02 * ((a."row" * 31 + a.col * 17 + k * 7) % 23 - 11) / {X.K_SQL} AS b FROM s a JOIN p ON a.e = i JOIN s b ON b.e = j AND b."row" = a."row" AND b.col = a.col),
w AS (SELECT "row", col, k, b, 2 * {_G} * {_G} / (1 - {_G} * {_G}) AS w FROM o),
n AS (SELECT "row", col, sum(w) FILTER (k <> 1) AS m00, sum(w) FILTER (k = 2) AS m01, sum(w) FILTER (k <> 0) AS m11, sum(w * b) FILTER (k <> 1) AS r0, sum(w * b) FILTER (k <> 0) AS r1, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(*) = 3)
SELECT "row", col, {rs('(m11 * r0 - m01 * r1) / (m00 * m11 - m01 * m01)', 'd1', 7)}, {rs('(m11 * r0 - m01 * r1 + m00 * r1 - m01 * r0) / (m00 * m11 - m01 * m01)', 'd2', 7)} FROM n""")
def weighted_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.stack(spark, sf_dir, _TRIANGLE, noise=0.02)
    got = inversion.invert(Stack(s.px, s.epochs[:3], _TRIANGLE, s.shape, s.meta), "variance").px.where("disp[2] is not null")
    return got.select("row", "col", r(F.col("disp")[1], 7).alias("d1"), r(F.col("disp")[2], 7).alias("d2"))


@query()
def robust_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inversion.invert(X.stack(spark, sf_dir, noise=0.02), "coherence", robust=True).px


@query()
def dem_error_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inversion.invert(X.stack(spark, sf_dir, noise=0.02), dem_range_m=850e3).px


@query(f"""WITH {X.series_sql('s', 1, X.DAILY)}, w AS (SELECT "row", col FROM s GROUP BY 1, 2 HAVING count(*) = {X.DAILY})
SELECT s."row", s.col, s.e AS epoch_idx, {rs('s.d - z.d', 'disp_m')} FROM s JOIN w ON w."row" = s."row" AND w.col = s.col JOIN s z ON z."row" = s."row" AND z.col = s.col AND z.e = 0""")
def gappy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty daily epochs with natural gaps: an epoch without data leaves its pairs out, and the pixel, which they no longer connect, has no series."""
    n = X.DAILY
    pairs = tuple(Pair(i, j) for i in range(n) for j in range(i + 1, min(n, i + 5)))
    px = X.series(spark, sf_dir, 1, n).px
    px = px.select("row", "col", F.array(*[P.displacement_to_phase(X.disp_at(p.sec) - X.disp_at(p.ref)) for p in pairs]).alias("phase"))
    got = inversion.invert(Stack(px, X.every(X.FIRST, 1, n), pairs, (1 << 30, 1 << 30))).px
    long = to_long(got, "epoch_idx", "disp_m", "disp").where("disp_m is not null")
    return long.select("row", "col", "epoch_idx", r(F.col("disp_m")).alias("disp_m"))


@query(f"WITH {X.stack_sql()} SELECT \"row\", col, k AS pair_idx, {rs('phase', 'phase')} FROM o SEMI JOIN full_px USING (\"row\", col)")
def closure_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cycles added to one pair of some pixels are found and taken away again."""
    fixed, _ = inversion.correct_closure(X.stack(spark, sf_dir, one_jump=True))
    px = fixed.px.where(~F.exists("phase", lambda x: x.isNull()))
    return to_long(px, "pair_idx", "phase", "phase").select("row", "col", "pair_idx", r(F.col("phase")).alias("phase"))


# --- corrections ---

_XY = "(SELECT max(\"row\") AS mr, max(col) AS mc FROM s)"


@query(f"""WITH {X.series_sql()}, b AS (SELECT "row", col, e, d, col / mc::DOUBLE AS x, "row" / mr::DOUBLE AS y FROM s, {_XY}),
n AS (SELECT e, avg(x) AS mx, avg(y) AS my, avg(d) AS md, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, d) AS xd, covar_pop(y, d) AS yd FROM b GROUP BY e)
SELECT "row", col, b.e AS epoch_idx, {rs('d - md - (yy * xd - xy * yd) / (xx * yy - xy * xy) * (x - mx) - (xx * yd - xy * xd) / (xx * yy - xy * xy) * (y - my)', 'disp_m')} FROM b JOIN n ON b.e = n.e""")
def deramped(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filters.deramp(X.series(spark, sf_dir, with_shape=True)).px
    return to_long(got, "epoch_idx", "disp_m", "disp").where("disp_m is not null").select("row", "col", "epoch_idx", r(F.col("disp_m")).alias("disp_m"))


_H = '(("row" * 37 + col * 11) % 3000)::DOUBLE'


@query(f"""WITH {X.series_sql()}, n AS (SELECT e, regr_slope(d, {_H}) AS k, avg({_H}) AS m FROM s GROUP BY e)
SELECT "row", col, s.e AS epoch_idx, {rs(f'd - k * ({_H} - m)', 'disp_m')} FROM s JOIN n ON s.e = n.e""")
def topography_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.series(spark, sf_dir)
    s = s.with_px(s.px.withColumn("height_m", ((F.col("row") * 37 + F.col("col") * 11) % 3000).cast("double")))
    got = filters.correct_topography(s).px
    return to_long(got, "epoch_idx", "disp_m", "disp").where("disp_m is not null").select("row", "col", "epoch_idx", r(F.col("disp_m")).alias("disp_m"))


_HP = f"""h AS (SELECT a."row", a.col, a.e, a.d - avg(b.d) AS v FROM s a SEMI JOIN full_px USING ("row", col) JOIN s b ON b."row" = a."row" AND b.col = a.col AND abs(b.e - a.e) <= least(1, a.e, {X.EPOCHS - 1} - a.e) GROUP BY a."row", a.col, a.e, a.d)"""
_FULL = f'full_px AS (SELECT "row", col FROM s GROUP BY 1, 2 HAVING count(*) = {X.EPOCHS})'


@query(f"WITH {X.series_sql()}, {_FULL}, {_HP} SELECT \"row\", col, e AS epoch_idx, {rs('v', 'hp')} FROM h")
def temporal_high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filters.high_pass(X.series(spark, sf_dir), 3)
    return to_long(got, "epoch_idx", "hp", "hp").where("hp is not null").select("row", "col", "epoch_idx", r(F.col("hp")).alias("hp"))


def _blur(source: str, value: str) -> str:
    w = 'exp(-((a."row" - b."row") ** 2 + (a.col - b.col) ** 2) / 2.0)'
    return f'SELECT a."row", a.col, a.e, a.{value} AS own, sum({w} * b.{value}) / sum({w}) AS v FROM {source} a JOIN {source} b ON a.e = b.e AND abs(a."row" - b."row") <= 3 AND abs(a.col - b.col) <= 3 GROUP BY 1, 2, 3, 4'


@query(f"WITH {X.series_sql()}, q AS ({_blur('s', 'd')}) SELECT \"row\", col, e AS epoch_idx, {rs('v', 'smooth')} FROM q")
def spatial_low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filters.low_pass(X.long_series(spark, sf_dir), "epoch_idx", "disp_m", 1.0)
    return got.select("row", "col", "epoch_idx", r(F.col("disp_m")).alias("smooth"))


@query(f"""WITH {X.series_sql()}, {_FULL}, {_HP}, q AS ({_blur('h', 'v')})
SELECT s."row", s.col, s.e AS epoch_idx, {rs('d - coalesce(q.v, 0)', 'disp_m')} FROM s LEFT JOIN q ON q."row" = s."row" AND q.col = s.col AND q.e = s.e""")
def aps_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filters.correct_aps(X.series(spark, sf_dir), 1.0, 3).px
    return to_long(got, "epoch_idx", "disp_m", "disp").where("disp_m is not null").select("row", "col", "epoch_idx", r(F.col("disp_m")).alias("disp_m"))


_DELAY = '0.001 * (("row" + col * 3 + {e} * 7) % 13)'


@query(f"WITH {X.series_sql()} SELECT \"row\", col, e AS epoch_idx, {rs(f'd + {_DELAY.format(e="e")} - {_DELAY.format(e=2)}', 'disp_m')} FROM s")
def delay_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.series(spark, sf_dir)
    delay = F.transform(F.sequence(F.lit(0), F.lit(X.EPOCHS - 1)), lambda e: 0.001 * ((F.col("row") + F.col("col") * 3 + e * 7) % 13))
    got = troposphere.correct_series(s, s.px.select("row", "col", delay.alias("delay")), 2).px
    return to_long(got, "epoch_idx", "disp_m", "disp").where("disp_m is not null").select("row", "col", "epoch_idx", r(F.col("disp_m")).alias("disp_m"))


_WET = "(71.6 - 77.6 * 0.622) * ep / tk + 3.75e5 * ep / (tk * tk)"


@query(f"""WITH {_PX}, l AS (SELECT "row", col, i, i * 1000.0 AS z, 1013.25 * exp(-i / 8.0) AS pr, 288.15 - 6.5 * i AS tk, 0.001 * (col + 1) * exp(-i / 2.0) AS q FROM px, (SELECT unnest(range(0, 12)) AS i)),
w AS (SELECT "row", col, i, z, q * pr / (0.622 + (1 - 0.622) * q) AS ep, tk FROM l), x AS (SELECT "row", col, i, z, {_WET} AS n FROM w),
y AS (SELECT "row", col, (z - lag(z) OVER k) * (n + lag(n) OVER k) / 2 AS a FROM x WINDOW k AS (PARTITION BY "row", col ORDER BY i)) SELECT "row", col, {rs('sum(a) * 1e-6', 'zwd_m', 9)} FROM y GROUP BY 1, 2""")
def zenith_wet_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct((i * 1000.0).alias("height_m"), (1013.25 * F.exp(-i / 8.0)).alias("pressure_hpa"), (288.15 - 6.5 * i).alias("temperature_k"), (F.col("q") * F.exp(-i / 2.0)).alias("specific_humidity")))
    return _pixels(spark, sf_dir).select("row", "col", r(troposphere.zenith_wet(F.shuffle(level), F.lit(0.0)), 9).alias("zwd_m"))


# --- decomposition, features, unwrapping ---

_U1, _U2 = "cos(radians(inc))", "cos(radians(inc + 4))"
_E1, _E2 = "-sin(radians(inc)) * cos(radians(-12))", "-sin(radians(inc + 4)) * cos(radians(-168))"


@query(f"""WITH {_PX}, m AS (SELECT px."row", px.col, 0.01 * (px."row" % 7) - 0.02 AS v1, 0.003 * (px.col % 5) AS v2, {_U1} AS u1, {_U2} AS u2, {_E1} AS e1, {_E2} AS e2 FROM px)
SELECT "row", col, {rs('(v1 * e2 - v2 * e1) / (u1 * e2 - u2 * e1)', 'up')}, {rs('(u1 * v2 - u2 * v1) / (u1 * e2 - u2 * e1)', 'east')} FROM m""")
def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir).select("row", "col", (0.01 * (F.col("row") % 7) - 0.02).alias("v1"), (0.003 * (F.col("col") % 5)).alias("v2"), F.col("inc").alias("i1"), (F.col("inc") + 4).alias("i2"), F.lit(-12.0).alias("h1"), F.lit(-168.0).alias("h2"))
    got = D.decompose_per_pixel(px, ["v1", "v2"], ["i1", "i2"], ["h1", "h2"])
    return got.select("row", "col", r(F.col("up")).alias("up"), r(F.col("east")).alias("east"))


@query(f"""WITH {_PX}, g AS (SELECT cos(radians(39)) AS u, sin(radians(39)) * cos(radians(-12)) AS a, sin(radians(39)) * cos(radians(-168)) AS b),
m AS (SELECT px."row", px.col, 0.01 * (px."row" % 7) - 0.02 AS v1, 0.003 * (px.col % 5) AS v2 FROM px)
SELECT "row", col, {rs('(v1 * -b + v2 * a) / (u * -b + u * a)', 'up')}, {rs('(u * v2 - u * v1) / (u * -b + u * a)', 'east')} FROM m, g""")
def decomposed_asc_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir).select("row", "col", (0.01 * (F.col("row") % 7) - 0.02).alias("v1"), (0.003 * (F.col("col") % 5)).alias("v2"))
    got = D.decompose_asc_desc(px, "v1", "v2")
    return got.select("row", "col", r(F.col("up")).alias("up"), r(F.col("east")).alias("east"))


_FEAT = f"""{X.series_sql('s', 1, X.DAILY)}, {_MODEL},
g AS (SELECT s.*, a, b, tm, m.n AS k, d - lag(d) OVER (PARTITION BY s."row", s.col ORDER BY e) AS step FROM s JOIN m ON s."row" = m."row" AND s.col = m.col),
q AS (SELECT "row", col, max(k) AS k, max(b) AS velocity, sqrt(sum((d - a - b * t) ** 2) / (max(k) - 2) / sum((t - tm) ** 2)) AS velocity_std,
  greatest(0, least(1, 1 - sum((d - a - b * t) ** 2) / (var_pop(d) * max(k)))) AS linearity_r2, sqrt(sum((d - a - b * t) ** 2) / max(k)) AS residual_rms,
  max_by(d, e) - min_by(d, e) AS cumulative, max(abs(step)) AS max_step FROM g GROUP BY 1, 2 HAVING max(k) >= 5)"""
_LINEAR = FE.FeatureConfig(acceleration=False, seasonal=False)
_NAMES = FE.names(_LINEAR)
_DIGITS = {"cumulative": 6, "max_step": 6}  # multiples of 1e-6: fewer digits would round at a tie


@query(f"WITH {_FEAT} SELECT \"row\", col, {', '.join(rs(c, c, _DIGITS.get(c, 5)) for c in _NAMES)} FROM q")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = FE.extract(X.series(spark, sf_dir, 1, X.DAILY), _LINEAR).where("velocity is not null")
    return got.select("row", "col", *(r(F.col(c), _DIGITS.get(c, 5)).alias(c) for c in _NAMES))


@query(f"WITH {_FEAT} SELECT \"row\", col, {rs('4000.0 + (col + 0.5) * 30', 'x')}, {rs('9000.0 - (\"row\" + 0.5) * 30', 'y')}, {', '.join(rs(c, c, _DIGITS.get(c, 5)) for c in _NAMES)} FROM q WHERE col % 3 <> 1")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = FE.extract(X.series(spark, sf_dir, 1, X.DAILY), _LINEAR)
    mask = X.long_series(spark, sf_dir).select("row", "col", (F.col("col") % 3 != 1).alias("keep")).distinct()
    rows = FE.to_table(got, _NAMES, (4000.0, 9000.0, 30.0, -30.0), mask)
    return rows.select("row", "col", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), *(r(F.col(c), _DIGITS.get(c, 5)).alias(c) for c in _NAMES))


@query(f"WITH {_FEAT} SELECT \"row\", col, {rs('4000.0 + (col + 0.5) * 30', 'x')}, {rs('9000.0 - (\"row\" + 0.5) * 30', 'y')}, {', '.join(rs(c, c, _DIGITS.get(c, 5)) for c in _NAMES)} FROM q")
def feature_table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_table of every pixel that has the features, without a mask."""
    rows = FE.to_table(FE.extract(X.series(spark, sf_dir, 1, X.DAILY), _LINEAR), _NAMES, (4000.0, 9000.0, 30.0, -30.0))
    return rows.select("row", "col", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), *(r(F.col(c), _DIGITS.get(c, 5)).alias(c) for c in _NAMES))


@query()
def features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.extract(X.series(spark, sf_dir, 1, X.DAILY))


_TRUE = '(0.45 * "row" + 0.35 * col + 0.01 * k)'
_CYCLES = "round((0.45 * ((mr + 1) // 2) + 0.35 * ((mc + 1) // 2) + 0.01 * k) / (2 * pi()))"


@query(f"""WITH {X.series_sql()}, px AS (SELECT DISTINCT "row", col FROM s) SELECT "row", col, k::INT AS pair_idx, {rs(f'{_TRUE} - 2 * pi() * {_CYCLES}', 'phase')}
FROM px, {_XY}, (SELECT unnest(range(0, 4)) AS k)""")
def unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = X.long_series(spark, sf_dir).select("row", "col").distinct()
    layers = px.select("row", "col", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pair_idx"))
    f = 0.45 * F.col("row") + 0.35 * F.col("col") + 0.01 * F.col("pair_idx")
    layers = layers.select("row", "col", "pair_idx", F.cos(f).alias("re"), F.sin(f).alias("im"))
    got = unwrapping.unwrap_stack(layers, X.shape(px))
    return got.select("row", "col", "pair_idx", r(F.col("phase")).alias("phase"))


@query(f"WITH {X.series_sql('s', 1, X.DAILY)} SELECT \"row\", col, e AS epoch_idx, {rs('d', 'disp_m')} FROM s")
def cube_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = to_pixels(X.long_series(spark, sf_dir, 1, X.DAILY), "epoch_idx", X.DAILY, disp="disp_m")
    return to_long(px, "epoch_idx", "disp_m", "disp").where("disp_m is not null").select("row", "col", "epoch_idx", r(F.col("disp_m")).alias("disp_m"))
