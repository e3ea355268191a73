"""Classifying pixels from their features: spatial-block validation, and prediction sets with a stated coverage.

Neighbouring pixels are alike, so folds by pixel flatter a classifier; folds by square blocks do not.
Blocks, folds and the calibration part follow from hashes of places, not from drawn rows, so reruns agree
and nothing is gathered to deal them. Prediction sets take one number from the calibration scores, an
order statistic that Spark finds exactly.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import InversionError, MetadataError
from fringeflow.store import materialize

BLOCK, FOLDS = 32, 5


def fold(folds: int = FOLDS, block: int | None = BLOCK, seed: int = 0) -> Column:
    """The fold of columns row, col: one for each block of block x block pixels, or for each pixel if block is None."""
    if folds < 2 or (block is not None and block < 1):
        raise MetadataError("two folds and a block of a pixel at least")
    r, c = (F.floor(F.col(k) / (block or 1)).cast("long") for k in ("row", "col"))
    return F.pmod(F.xxhash64(r, c, F.lit(seed)), F.lit(folds)).cast("int")


def scores(judged: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """fold, n, accuracy, f1 (of label 1; NULL where neither label nor prediction has it) of rows with a fold."""
    hit = lambda *c: F.sum(F.when(F.expr(" and ".join(c)), 1).otherwise(0))
    right = F.avg((F.col(label) == F.col(predicted)).cast("double"))
    both, miss, false = hit(f"{label} = 1", f"{predicted} = 1"), hit(f"{label} = 1", f"{predicted} <> 1"), hit(f"{label} <> 1", f"{predicted} = 1")
    return judged.groupBy("fold").agg(F.count("*").alias("n"), right.alias("accuracy"), F.when(2 * both + miss + false > 0, 2 * both / (2 * both + miss + false)).alias("f1"))


def _vectors(px: DataFrame, features: list[str], label: str) -> DataFrame:
    rows = px.where(F.expr(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in features)) & F.col(label).isNotNull())
    return VectorAssembler(inputCols=features, outputCol="__x").transform(rows)


def _forest(label: str, trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol="__x", probabilityCol="__p", predictionCol="__y", rawPredictionCol="__r", numTrees=trees, maxDepth=depth, seed=seed)


def cross_validate(px: DataFrame, features: list[str], label: str = "label", folds: int = FOLDS, block: int | None = BLOCK, trees: int = 200, depth: int = 5, seed: int = 1) -> DataFrame:
    """fold, n, accuracy, f1: each fold judged by a random forest of the others. Rows that lack a feature or the label are left out; folds without rows on either side have no row."""
    rows = materialize(_vectors(px, features, label).withColumn("fold", fold(folds, block)), "folds")
    out = None
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if not train.limit(1).count() or not test.limit(1).count():
            continue
        judged = _forest(label, trees, depth, seed).fit(train).transform(test).select("fold", label, F.col("__y").alias("predicted"))
        judged = scores(judged, label)
        out = judged if out is None else out.unionByName(judged)
    if out is None:
        raise InversionError("no fold has rows to learn from and rows to judge")
    return out


def conformal_quantile(calibration: DataFrame, probabilities: str, label: str = "label", miss: float = 0.1) -> float:
    """The ceil((n + 1)(1 - miss))-th least of 1 - p[label] over the calibration rows; infinite where there are too few for the coverage asked for.

    Exact: counts by value narrow to the order statistic, and one number comes back. NULL probabilities or labels take no part.
    """
    if not 0 < miss < 1:
        raise MetadataError("the share of misses must be between 0 and 1")
    s = calibration.select((1 - F.try_element_at(F.col(probabilities), F.col(label).cast("int") + 1)).alias("s")).where("s is not null")
    n = s.count()
    k = math.ceil((n + 1) * (1 - miss) - 1e-9)
    if k > n:
        return math.inf
    return _order_statistic(s.groupBy("s").count(), k)


def _order_statistic(counts: DataFrame, k: int) -> float:
    """The k-th least of counts(s, count): values fall into 256 ranges, the one that holds it is divided again, until its values are few."""
    low, high = counts.agg(F.min("s"), F.max("s")).first()
    while True:
        if low == high:
            return low
        width = (high - low) / 256
        if width == 0 or low + width == low:
            break
        part = F.least(F.floor((F.col("s") - low) / width), F.lit(255))
        per = {r.b: (r.n, r.low, r.high, r.values) for r in counts.groupBy(part.alias("b")).agg(F.sum("count").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("values")).collect()}  # 256 rows
        for b in sorted(per):
            n, lo, hi, values = per[b]
            if k <= n:
                break
            k -= n
        counts = counts.where(F.col("s").between(lo, hi))
        low, high = lo, hi
        if values <= 1024:
            break
    for r in counts.orderBy("s").collect():  # few
        if k <= r["count"]:
            return r["s"]
        k -= r["count"]
    return high


def prediction_sets(judged: DataFrame, probabilities: str, quantile: float) -> DataFrame:
    """judged with `labels`: every label whose 1 - p is no more than the quantile; an infinite quantile gives all labels. NULL probabilities give NULL."""
    marked = F.transform(F.col(probabilities), lambda p, k: F.when(1 - p <= F.lit(quantile), k))
    return judged.withColumn("labels", F.filter(marked, lambda x: x.isNotNull()))


def conformal(px: DataFrame, features: list[str], label: str = "label", miss: float = 0.1, folds: int = 10, block: int = BLOCK, trees: int = 200, depth: int = 5, seed: int = 1) -> tuple[DataFrame, float]:
    """row, col, label, role (train, calibrate, test), p, labels; and the quantile: learnt on six tenths of the blocks, calibrated on two, sets for all."""
    rows = materialize(_vectors(px, features, label).withColumn("__f", fold(folds, block)).withColumn("role", F.when(F.col("__f") < 0.6 * folds, "train").when(F.col("__f") < 0.8 * folds, "calibrate").otherwise("test")), "roles")
    train = rows.where("role = 'train'")
    if not train.limit(1).count():
        raise InversionError("no blocks to learn from")
    made = _forest(label, trees, depth, seed).fit(train).transform(rows).select("row", "col", F.col(label).alias("label"), "role", vector_to_array("__p").alias("p"))
    made = materialize(made, "judged")
    q = conformal_quantile(made.where("role = 'calibrate'"), "p", "label", miss)
    return prediction_sets(made, "p", q), q
