"""Every registered query of the library against its SQL, and the driver's entry."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from fringeflow.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple("" if r[i] is None else round(r[i], 5) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name in plans.ORACLES:
        want = db.sql(plans.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows_of(got.columns, rows), rows_of(want.columns, want.fetchall())
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=2e-5) if all(isinstance(v, (int, float)) for v in x) else x == y
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
