"""Queries that run over every pixel of the tables."""

import pytest
from pyspark.sql import functions as F

from fringeflow.plans import fixtures as X
from fringeflow.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, days, n", [("coherence_weights_all", X.DAYS, X.EPOCHS), ("feature_table_all", 1, X.DAILY)])
def test_every_pixel_has_rows(spark, name, days, n):
    least = 5 if name == "feature_table_all" else 2
    px = X.long_series(spark, SF, days, n).groupBy("row", "col").count().where(F.col("count") >= least)
    want = {(r["row"], r["col"]) for r in px.collect()}
    got = {(r["row"], r["col"]) for r in plans.QUERIES[name](spark, SF).select("row", "col").distinct().collect()}
    assert got == want and any(r > 7 or c < 2 for r, c in got) == any(r > 7 or c < 2 for r, c in want)
