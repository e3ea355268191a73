"""Vertical and east motion from several viewing geometries, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import DimensionMismatch, InversionError
from fringeflow.functions.phase import los_vector, valid

COLLINEAR, TINY = 1e-9, 1e-30


def up_east(values: list[Column], east: list[Column], up: list[Column]) -> tuple[Column, Column]:
    """(up, east) by least squares; NULL where any value or direction is missing, or the directions are one."""

    def total(xs: list[Column]) -> Column:
        out = xs[0]
        for x in xs[1:]:
            out = out + x
        return out

    uu, ue, ee = (total([a * b for a, b in zip(x, y, strict=True)]) for x, y in ((up, up), (up, east), (east, east)))
    ud, ed = (total([a * v for a, v in zip(x, values, strict=True)]) for x in (up, east))
    det = uu * ee - ue * ue
    fine = det >= COLLINEAR * F.greatest(uu * ee, F.lit(TINY))
    return F.when(fine, (ee * ud - ue * ed) / det), F.when(fine, (uu * ed - ue * ud) / det)


def decompose(maps: DataFrame, values: list[str], geometries: list[tuple[float, float]]) -> DataFrame:
    """row, col, up, east from a column for each geometry (incidence, heading in degrees), the same all over the map."""
    if len(values) != len(geometries) or len(values) < 2:
        raise DimensionMismatch("two geometries or more are needed, one for each value")
    east = [-math.sin(math.radians(i)) * math.cos(math.radians(h)) for i, h in geometries]
    up = [math.cos(math.radians(i)) for i, _ in geometries]
    uu, ee, ue = sum(x * x for x in up), sum(x * x for x in east), sum(a * b for a, b in zip(up, east, strict=True))
    if uu * ee - ue * ue < COLLINEAR * max(uu * ee, TINY):
        raise InversionError("the geometries cannot tell up from east")
    u, e = up_east([valid(F.col(v)) for v in values], [F.lit(x) for x in east], [F.lit(x) for x in up])
    return maps.select("row", "col", u.alias("up"), e.alias("east"))


def decompose_per_pixel(maps: DataFrame, values: list[str], incidence: list[str], heading: list[str]) -> DataFrame:
    """The same with a column of incidence and of heading for each value; NULL where a pixel's directions are one."""
    if not len(values) == len(incidence) == len(heading) or len(values) < 2:
        raise DimensionMismatch("two geometries or more are needed, one for each value")
    los = [los_vector(valid(F.col(i)), valid(F.col(h))) for i, h in zip(incidence, heading, strict=True)]
    u, e = up_east([valid(F.col(v)) for v in values], [x["east"] for x in los], [x["up"] for x in los])
    return maps.select("row", "col", u.alias("up"), e.alias("east"))


def decompose_asc_desc(maps: DataFrame, ascending: str, descending: str, asc: tuple[float, float] = (39.0, -12.0), desc: tuple[float, float] = (39.0, -168.0)) -> DataFrame:
    return decompose(maps, [ascending, descending], [asc, desc])
