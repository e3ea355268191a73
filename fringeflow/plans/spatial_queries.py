"""Registered queries over space: variograms, kriging, terrain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.operators import kriging, troposphere, validation
from fringeflow.plans import fixtures as X
from fringeflow.plans.queries import query, r, rs

# every pixel's cents of all epochs; a quarter of the pixels, by those cents, are gaps
_PX = f"""{X.series_sql()}, t AS (SELECT "row", col, sum(cents)::BIGINT AS c FROM s GROUP BY 1, 2),
known AS (SELECT "row", col, c::DOUBLE * 0.0001 AS v FROM t WHERE abs(c) % 4 <> 0), gap AS (SELECT "row", col FROM t WHERE abs(c) % 4 = 0)"""
_MODEL = kriging.Variogram("exponential", 0.1, 2.0, 12.0)
_FAR = 6.0


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.long_series(spark, sf_dir).groupBy("row", "col").agg(F.sum("cents").alias("c"))
    return t.select("row", "col", F.when(F.abs("c") % 4 != 0, F.col("c").cast("double") * 0.0001).alias("value"))


@query(f"""WITH {_PX}, d AS (SELECT sqrt((a."row" - b."row") ** 2 + (a.col - b.col) ** 2) AS h, (a.v - b.v) ** 2 AS s FROM known a JOIN known b
  ON (b."row" > a."row" OR (b."row" = a."row" AND b.col > a.col)) AND (a."row" - b."row") ** 2 + (a.col - b.col) ** 2 <= {_FAR**2})
SELECT (ceil(h * {kriging.LAGS} / {_FAR} - 1e-9) - 1)::INT AS lag, {rs('avg(h)', 'distance')}, {rs('avg(s) / 2', 'gamma', 5)}, count(*) AS pairs FROM d GROUP BY 1""")
def variogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = kriging.variogram(_sampled(spark, sf_dir), _FAR)
    return got.select("lag", r(F.col("distance")).alias("distance"), r(F.col("gamma"), 5).alias("gamma"), "pairs")


def _semi(h: str) -> str:
    return f"(CASE WHEN {h} = 0 THEN 0 ELSE {_MODEL.nugget} + {_MODEL.sill} * (1 - exp(-3 * {h} / {_MODEL.reach})) END)"


@query(f"""WITH {_PX}, n AS (SELECT g."row", g.col, k."row" AS r, k.col AS c, v, sqrt((g."row" - k."row") ** 2 + (g.col - k.col) ** 2) AS h,
  row_number() OVER (PARTITION BY g."row", g.col ORDER BY (g."row" - k."row") ** 2 + (g.col - k.col) ** 2, k."row", k.col) AS i FROM gap g, known k QUALIFY i <= 2),
p AS (SELECT a."row", a.col, a.v AS v1, b.v AS v2, {_semi('a.h')} AS g1, {_semi('b.h')} AS g2, {_semi('sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2)')} AS g12 FROM n a JOIN n b ON a."row" = b."row" AND a.col = b.col AND a.i = 1 AND b.i = 2),
l AS (SELECT *, 0.5 + (g2 - g1) / (2 * g12) AS l1 FROM p)
SELECT "row", col, {rs('l1 * v1 + (1 - l1) * v2', 'value', 5)}, {rs('sqrt(l1 * g1 + (1 - l1) * g2 + g1 - (1 - l1) * g12)', 'sigma', 5)} FROM l""")
def kriged_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap from its two nearest samples, by a stated variogram: the weights have a closed form."""
    got = kriging.krige(_sampled(spark, sf_dir), _MODEL, 2)
    return got.select("row", "col", r(F.col("value"), 5).alias("value"), r(F.col("sigma"), 5).alias("sigma"))


@query(f"""WITH {_PX}, m AS (SELECT g."row", g.col, min((g."row" - k."row") ** 2 + (g.col - k.col) ** 2) AS d FROM gap g, known k GROUP BY 1, 2),
n AS (SELECT m."row", m.col, k.v, d FROM m JOIN known k ON (m."row" - k."row") ** 2 + (m.col - k.col) ** 2 = d QUALIFY row_number() OVER (PARTITION BY m."row", m.col ORDER BY k."row", k.col) = 1)
SELECT "row", col, {rs('v', 'value', 5)}, {rs(f'sqrt(2 * {_semi("sqrt(d)")})', 'sigma', 5)} FROM n""")
def kriged_by_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap from its nearest sample."""
    got = kriging.krige(_sampled(spark, sf_dir), _MODEL, 1)
    return got.select("row", "col", r(F.col("value"), 5).alias("value"), r(F.col("sigma"), 5).alias("sigma"))


@query()
def gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels, gaps filled from 40 neighbours by the best of three fitted variograms."""
    return kriging.fill(_sampled(spark, sf_dir), _FAR)[0]


_HEIGHT = 'abs(c) % 3000 / 2.0 + "row" * 3'


@query(f"""WITH {_PX}, h AS (SELECT "row", col, {_HEIGHT} AS z FROM t), e AS (SELECT max("row") AS mr, max(col) AS mc FROM h),
n AS (SELECT a."row", a.col, a.z, CASE WHEN a.col = mc THEN a.z ELSE east.z END AS e, CASE WHEN a.col = 0 THEN a.z ELSE west.z END AS w, CASE WHEN a."row" = mr THEN a.z ELSE south.z END AS s, CASE WHEN a."row" = 0 THEN a.z ELSE north.z END AS n
  FROM h a JOIN e ON true LEFT JOIN h east ON east."row" = a."row" AND east.col = a.col + 1 LEFT JOIN h west ON west."row" = a."row" AND west.col = a.col - 1
  LEFT JOIN h south ON south."row" = a."row" + 1 AND south.col = a.col LEFT JOIN h north ON north."row" = a."row" - 1 AND north.col = a.col)
SELECT "row", col, z AS height_m, {rs('sqrt(((e - w) / 2) ** 2 + ((s - n) / 2) ** 2)', 'slope')} FROM n""")
def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = _heights(spark, sf_dir)
    return kriging.slope(heights, X.shape(heights)).select("row", "col", "height_m", r(F.col("slope")).alias("slope"))


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.long_series(spark, sf_dir).groupBy("row", "col").agg(F.sum("cents").alias("c"))
    return t.select("row", "col", (F.abs("c") % 3000 / 2.0 + F.col("row") * 3).cast("double").alias("height_m"))


@query()
def regression_kriged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trend of height and slope by a random forest, its residuals kriged into the gaps."""
    heights = _heights(spark, sf_dir)
    terrain = kriging.slope(heights, X.shape(heights))
    px = _sampled(spark, sf_dir).join(terrain, ["row", "col"])
    return kriging.regression_fill(px.withColumn("slope", F.coalesce("slope", F.lit(0.0))), ["height_m", "slope"], _FAR, trees=20)[0]


# --- weather grids ---


@query(f"""WITH {X.series_sql()}, f AS (SELECT "row", col, sum(cents)::BIGINT AS c FROM s GROUP BY 1, 2), x AS (SELECT max("row") AS mr, max(col) AS mc FROM f),
n AS (SELECT i, j, e, 280 + (abs(coalesce(c, 0)) + e) % 17 AS t, (5 + abs(coalesce(c, 0)) % 7) / 1000.0 AS q FROM x, LATERAL (SELECT unnest(range(0, mr // 4 + 2)) AS i), LATERAL (SELECT unnest(range(0, mc // 4 + 2)) AS j), (SELECT unnest(range(0, 2)) AS e) LEFT JOIN f ON f."row" = 4 * i AND f.col = 4 * j),
p AS (SELECT "row", col, "row" // 4 AS i, col // 4 AS j, ("row" % 4) / 4.0 AS u, (col % 4) / 4.0 AS v FROM f)
SELECT p."row", p.col, a.e::INT AS epoch_idx, k::INT AS level, {rs('(1 - u) * (1 - v) * (a.t - 6 * k) + (1 - u) * v * (b.t - 6 * k) + u * (1 - v) * (c.t - 6 * k) + u * v * (d.t - 6 * k)', 'temperature_k', 5)},
  {rs('((1 - u) * (1 - v) * a.q + (1 - u) * v * b.q + u * (1 - v) * c.q + u * v * d.q) * exp(-k / 2.0)', 'humidity', 9)}
FROM p JOIN n a ON a.i = p.i AND a.j = p.j JOIN n b ON b.i = p.i AND b.j = p.j + 1 AND b.e = a.e JOIN n c ON c.i = p.i + 1 AND c.j = p.j AND c.e = a.e JOIN n d ON d.i = p.i + 1 AND d.j = p.j + 1 AND d.e = a.e, (SELECT unnest(range(0, 5)) AS k)""")
def weather_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse grid of profiles, from every fourth pixel of the table, at every pixel: four corners, bilinear level by level."""
    nodes, px, origin, spacing = _weather(spark, sf_dir)
    got = troposphere.profiles_at(nodes, px, origin, spacing).select("row", "col", "epoch_idx", F.posexplode("levels").alias("level", "x"))
    return got.select("row", "col", "epoch_idx", "level", r(F.col("x.temperature_k"), 5).alias("temperature_k"), r(F.col("x.specific_humidity"), 9).alias("humidity"))


@query()
def weather_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays along the line of sight of every pixel and epoch from the same grid."""
    nodes, px, origin, spacing = _weather(spark, sf_dir)
    return troposphere.delays_at(nodes, px, origin, spacing, 39.0)


def _weather(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, tuple[float, float], tuple[float, float]]:
    t = X.long_series(spark, sf_dir).groupBy("row", "col").agg(F.sum("cents").alias("c"))
    rows, cols = X.shape(t)
    n, m = (rows - 1) // 4 + 2, (cols - 1) // 4 + 2
    at = spark.range(n * m).select((F.col("id") / m).cast("int").alias("i"), (F.col("id") % m).cast("int").alias("j"))
    at = at.join(t.select((F.col("row") / 4).alias("i"), (F.col("col") / 4).alias("j"), "c"), ["i", "j"], "left").select("i", "j", F.abs(F.coalesce("c", F.lit(0))).alias("c"))
    at = at.withColumn("epoch_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    level = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct((k * 1000.0).alias("height_m"), (1000.0 * F.exp(-k / 8.0)).alias("pressure_hpa"), (280.0 + (F.col("c") + F.col("epoch_idx")) % 17 - 6 * k).cast("double").alias("temperature_k"), ((5 + F.col("c") % 7) / 1000.0 * F.exp(-k / 2.0)).alias("specific_humidity")))
    nodes = at.select("epoch_idx", (-30.0 - F.col("i") * 0.25).alias("lat"), (-70.0 + F.col("j") * 0.25).alias("lon"), level.alias("levels"))
    px = t.select("row", "col", (-30.0 - F.col("row") * 0.0625).alias("lat"), (-70.0 + F.col("col") * 0.0625).alias("lon"), (F.abs("c") % 3000).cast("double").alias("height_m"))
    return nodes, px, (-30.0, -70.0), (-0.25, 0.25)


# --- prediction sets ---

_MISS = 0.2


@query(f"""WITH {X.series_sql()}, t AS (SELECT "row", col, abs(sum(cents))::BIGINT AS c FROM s GROUP BY 1, 2), p AS (SELECT "row", col, c % 3 AS label, (1 + c % 7) / 20.0::DOUBLE AS p0, (1 + c % 5) / 20.0::DOUBLE AS p1 FROM t),
f AS (SELECT *, 1 - p0 - p1 AS p2 FROM p), k AS (SELECT 1 - (CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS s FROM f WHERE ("row" + col) % 2 = 0),
o AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM k), q AS (SELECT coalesce(max(s) FILTER (i = ceil((n + 1) * {1 - _MISS} - 1e-9)), 'inf'::DOUBLE) AS q FROM o)
SELECT "row", col, label, (1 - p0 <= q)::INT AS has_0, (1 - p1 <= q)::INT AS has_1, (1 - p2 <= q)::INT AS has_2 FROM f, q""")
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction sets of three classes from stated probabilities, calibrated on half of the pixels."""
    t = X.long_series(spark, sf_dir).groupBy("row", "col").agg(F.abs(F.sum("cents")).alias("c"))
    p0, p1 = ((1 + F.col("c") % n) / F.lit(20.0) for n in (7, 5))
    px = t.select("row", "col", (F.col("c") % 3).alias("label"), F.array(p0, p1, 1 - p0 - p1).alias("p"))
    q = validation.conformal_quantile(px.where((F.col("row") + F.col("col")) % 2 == 0), "p", "label", _MISS)
    got = validation.prediction_sets(px, "p", q)
    return got.select("row", "col", "label", *(F.array_contains("labels", k).cast("int").alias(f"has_{k}") for k in range(3)))


@query()
def landslide_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and F1 of a forest on the pixels' features, fold by fold of blocks: which pixels move more than the middle one."""
    from fringeflow.operators import features as FE

    px = FE.extract(X.series(spark, sf_dir, 1, X.DAILY), FE.FeatureConfig(acceleration=False, seasonal=False)).na.drop()
    middle = px.agg(F.expr("percentile(abs(velocity), 0.5)")).first()[0]
    labelled = px.withColumn("label", (F.abs("velocity") > F.lit(middle or 0.0)).cast("double"))
    return validation.cross_validate(labelled, ["linearity_r2", "residual_rms", "max_step"], block=4, trees=10)
