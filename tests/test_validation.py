"""Blocks and folds, order statistics against a sort, and the coverage of prediction sets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.errors import MetadataError
from fringeflow.operators import validation


def test_a_block_is_in_one_fold(spark):
    px = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"))
    got = px.withColumn("fold", validation.fold(4, 8)).groupBy(F.floor(F.col("row") / 8).alias("r"), F.floor(F.col("col") / 8).alias("c")).agg(F.countDistinct("fold").alias("n"), F.first("fold").alias("f")).collect()
    assert all(r["n"] == 1 for r in got) and {r["f"] for r in got} == {0, 1, 2, 3}
    assert px.withColumn("fold", validation.fold(4, None)).where("row < 8 and col < 8").select("fold").distinct().count() == 4
    with pytest.raises(MetadataError):
        validation.fold(1)


@pytest.mark.parametrize("n", [1, 7, 40, 3000])
def test_order_statistics(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.random(n), 2 if n < 3000 else 9)
    counts = spark.createDataFrame([(float(v),) for v in x], "s double").groupBy("s").count()
    for k in {1, max(1, n // 2), n}:
        assert validation._order_statistic(counts, k) == np.sort(x)[k - 1]


def test_too_few_to_calibrate(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1])] * 5 + [(None, [0.5, 0.5]), (1, None)], "label int, p array<double>")
    assert validation.conformal_quantile(df, "p", miss=0.1) == math.inf
    assert validation.conformal_quantile(df, "p", miss=0.5) == pytest.approx(0.1)
    got = validation.prediction_sets(df, "p", math.inf).collect()
    assert [r["labels"] for r in got] == [[0, 1]] * 6 + [None]


def test_scores(spark):
    rows = [(0, 1, 1), (0, 1, 0), (0, 0, 1), (0, 0, 0), (1, 0, 0)]
    got = {r["fold"]: r for r in validation.scores(spark.createDataFrame(rows, "fold int, label int, predicted int")).collect()}
    assert (got[0]["n"], got[0]["accuracy"], got[0]["f1"]) == (4, 0.5, 0.5) and got[1]["f1"] is None and got[1]["accuracy"] == 1


def test_forest_in_blocks_and_its_sets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for r in range(60):
        for c in range(60):
            x, y = rng.normal(), rng.normal()
            rows.append((r, c, float(x), float(y), int(x + 0.5 * rng.normal() > 0)))
    px = spark.createDataFrame([*rows, (0, 99, None, 1.0, 1)], "row int, col int, x double, y double, label int")
    got = validation.cross_validate(px, ["x", "y"], folds=3, block=6, trees=10).collect()
    assert sum(r["n"] for r in got) == 3600 and all(r["accuracy"] > 0.75 for r in got)
    sets, q = validation.conformal(px, ["x", "y"], miss=0.1, block=6, trees=10)
    assert 0 < q < 1
    covered = sets.where("role = 'test'").agg(F.avg(F.array_contains("labels", F.col("label")).cast("double"))).first()[0]
    assert 0.84 < covered < 0.96
