"""A weather grid at pixels: planes are met exactly, and what lies outside has no levels."""

import math

import pytest

from fringeflow.operators import troposphere
from fringeflow.operators.cube import Series, every, to_pixels
from fringeflow.plans.fixtures import FIRST

LEVEL = troposphere.LEVEL


def plane(lat, lon, k, e):
    return (1000.0 * k, 1000.0 * math.exp(-k / 8), 290.0 + 2 * lat - lon - 6.5 * k + e, (0.004 + 0.001 * lat) * math.exp(-k / 2))


def nodes(spark, lost=()):
    rows = [(e, -i * 0.5, 10 + j * 0.5, [plane(-i * 0.5, 10 + j * 0.5, k, e) for k in range(6)]) for e in range(2) for i in range(4) for j in range(3) if (i, j) not in lost]
    return spark.createDataFrame(rows, f"epoch_idx int, lat double, lon double, levels array<{LEVEL}>")


def pixels(spark):
    rows = [(r, c, -0.1 * r, 10 + 0.125 * c, 100.0 * c) for r in range(16) for c in range(9)]
    return spark.createDataFrame([*rows, (99, 0, 0.2, 10.1, 0.0), (99, 1, -1.0, 11.2, 0.0)], "row int, col int, lat double, lon double, height_m double")


def test_planes_are_met(spark):
    got = troposphere.profiles_at(nodes(spark), pixels(spark), (0.0, 10.0), (-0.5, 0.5)).collect()
    assert len(got) == (16 * 9 + 2) * 2
    for r in got:
        if r["row"] == 99:
            assert r["levels"] is None
            continue
        for k, x in enumerate(r["levels"]):
            want = plane(r["lat"], r["lon"], k, r["epoch_idx"])
            assert tuple(x) == pytest.approx(want)


def test_cells_that_lack_a_corner(spark):
    got = troposphere.profiles_at(nodes(spark, {(1, 1)}), pixels(spark), (0.0, 10.0), (-0.5, 0.5)).where("row < 99").collect()
    for r in got:
        assert (r["levels"] is None) == (r["lat"] > -1.0 + 1e-9)


def test_delays_correct_a_series(spark):
    delays = troposphere.delays_at(nodes(spark), pixels(spark), (0.0, 10.0), (-0.5, 0.5), 39.0)
    rows = delays.where("row < 99").collect()
    assert len(rows) == 16 * 9 * 2 and all(2.0 < r["delay_m"] < 4.0 for r in rows)
    cube = to_pixels(delays, "epoch_idx", 2, delay="delay_m")
    by = {(r["row"], r["col"], r["epoch_idx"]): r["delay_m"] for r in rows}
    disp = spark.createDataFrame([(r, c, [0.0, by[r, c, 0] - by[r, c, 1]]) for r in range(16) for c in range(9)], "row int, col int, disp array<double>")
    out = troposphere.correct_series(Series(disp, every(FIRST, 12, 2), (16, 9)), cube).px.collect()
    assert all(x["disp"] == pytest.approx([0.0, 0.0], abs=1e-12) for x in out)


def test_errors(spark):
    with pytest.raises(Exception, match="two nodes"):
        troposphere.profiles_at(nodes(spark).where("lat = 0"), pixels(spark), (0.0, 10.0), (-0.5, 0.5))
    odd = nodes(spark).selectExpr("epoch_idx", "lat", "lon", "if(lat = 0 and lon = 10, slice(levels, 1, 3), levels) as levels")
    with pytest.raises(Exception, match="different levels"):
        troposphere.profiles_at(odd, pixels(spark), (0.0, 10.0), (-0.5, 0.5)).collect()
