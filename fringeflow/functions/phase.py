"""Column functions: phase and displacement, geometry, delays. NoData is NULL everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fringeflow.errors import MetadataError

# Fixed values of the domain.
WAVELENGTH_M = 0.05546576  # C band
GAS_RATIO = 0.622  # dry air to water vapour
K1, K2, K3 = 77.6, 71.6, 3.75e5  # refractivity, K/hPa, K/hPa, K^2/hPa
K2_PRIME = K2 - K1 * GAS_RATIO


def valid(x: Column) -> Column:
    """x where it is a finite number, else NULL."""
    d = x.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def phase_to_displacement(phase: Column, wavelength: float = WAVELENGTH_M) -> Column:
    """Positive phase is away from the satellite, so a negative displacement (metres along the line of sight)."""
    return phase * F.lit(-wavelength / (4 * math.pi))


def displacement_to_phase(disp: Column, wavelength: float = WAVELENGTH_M) -> Column:
    return disp * F.lit(-4 * math.pi / wavelength)


def wrapped_phase(re: Column, im: Column) -> Column:
    re, im = valid(re), valid(im)
    return F.when(re.isNotNull() & im.isNotNull(), F.atan2(im, re))


def wrap_diff(d: Column) -> Column:
    """d brought into (-pi, pi]."""
    two_pi = 2 * math.pi
    return d - F.lit(two_pi) * F.ceil((d - math.pi) / two_pi)


def coherence_weight(coh: Column, scheme: str = "variance") -> Column:
    """`unit`: 1; `coherence`: g; `variance`: 2g^2 / (1 - g^2), with g held within 0.01..0.99."""
    g = F.least(F.greatest(valid(coh), F.lit(0.01)), F.lit(0.99))
    if scheme == "unit":
        return F.when(g.isNotNull(), F.lit(1.0))
    if scheme == "coherence":
        return g
    if scheme == "variance":
        return 2 * g * g / (1 - g * g)
    raise MetadataError(f"unknown weighting {scheme}")


def coherence_mask(coh: Column, least: float) -> Column:
    """TRUE from `least` on; FALSE where there is no coherence."""
    return F.coalesce(valid(coh) >= least, F.lit(False))


def azimuth_to_heading(azimuth_deg: Column) -> Column:
    return 90 - azimuth_deg


def los_vector(incidence_deg: Column, heading_deg: Column) -> Column:
    """STRUCT<east, north, up>: the unit vector from the ground to a right-looking satellite."""
    i, h = F.radians(incidence_deg), F.radians(heading_deg)
    return F.struct((-F.sin(i) * F.cos(h)).alias("east"), (F.sin(i) * F.sin(h)).alias("north"), F.cos(i).alias("up"))


def days_since(epoch: Column, first: Column) -> Column:
    return F.datediff(epoch, first)


def years_since(epoch: Column, first: Column) -> Column:
    return F.datediff(epoch, first) / F.lit(365.25)


def in_region(row: Column, col: Column, region: tuple[int, int, int, int]) -> Column:
    """Inclusive (row0, col0, row1, col1); bounds beyond the grid do no harm."""
    r0, c0, r1, c1 = region
    if r0 > r1 or c0 > c1:
        raise MetadataError(f"region {region} is empty")
    return row.between(r0, r1) & col.between(c0, c1)


def pixel_to_geo(row: Column, col: Column, transform: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """x and y of a pixel's centre; transform is (x of the corner, y of the corner, width, height of a pixel)."""
    x0, y0, w, h = transform
    return x0 + (col + 0.5) * w, y0 + (row + 0.5) * h


def vapor_pressure(q: Column, pressure_hpa: Column) -> Column:
    return q * pressure_hpa / (GAS_RATIO + (1 - GAS_RATIO) * q)


def saastamoinen_zhd(pressure_hpa: Column, latitude_deg: Column, height_m: Column) -> Column:
    """Zenith hydrostatic delay, metres."""
    return 0.0022768 * pressure_hpa / (1 - 0.00266 * F.cos(2 * F.radians(latitude_deg)) - 0.00028 * height_m / 1000)


def project_to_los(zenith_delay: Column, incidence_deg: Column) -> Column:
    """Delay along the line of sight; an incidence outside [0, 90) stops the query."""
    good = (incidence_deg >= 0) & (incidence_deg < 90)
    return F.when(good, zenith_delay / F.cos(F.radians(incidence_deg))).when(incidence_deg.isNotNull(), F.raise_error(F.lit("incidence must be in [0, 90) degrees")).cast("double"))
