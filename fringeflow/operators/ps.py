"""Persistent scatterers: amplitude dispersion and the selection of stable pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.errors import InversionError
from fringeflow.operators.cube import as_stored, map_pixels, numbers

LEAST_MEAN = 1.1920929e-7  # single-precision epsilon


def amplitude_dispersion(amp: DataFrame, n_epochs: int) -> DataFrame:
    """amp(row, col, epoch_idx, amplitude) -> row, col, amp_dispersion: deviation (n - 1) over mean.

    NULL if any of the n_epochs is absent, NULL or NaN (infinite amplitudes go through, as NULL), with
    fewer than two epochs, or where the mean is negligible.
    """
    if n_epochs < 1:
        raise InversionError("no epochs")
    a = F.when(~F.isnan("amplitude"), F.col("amplitude").cast("double"))
    stats = amp.groupBy("row", "col").agg(F.count(a).alias("n"), F.stddev_samp(a).alias("s"), F.avg(a).alias("m"))
    d = F.when((F.col("n") == n_epochs) & (F.col("n") >= 2) & (F.abs("m") > LEAST_MEAN), F.col("s") / F.col("m"))
    return stats.select("row", "col", F.when(~F.isnan(d), d).alias("amp_dispersion"))


def dispersion_of_arrays(px: DataFrame, n_epochs: int, column: str = "amplitude") -> DataFrame:
    """The same of px(row, col, amplitude ARRAY over the epochs), without a shuffle; arrays of another length stop the query, a NULL array is a pixel without data."""
    if n_epochs < 1:
        raise InversionError("no epochs")

    def kernel(amp):
        x = as_stored(amp, n_epochs)
        with np.errstate(all="ignore"):
            m = x.mean(axis=1)
            d = x - m[:, None]
            out = np.sqrt(np.einsum("ij,ij->i", d, d) / (n_epochs - 1)) / m
        return [numbers(np.where((np.abs(m) > LEAST_MEAN) & np.isfinite(out), out, np.nan))]

    return map_pixels(px, [column], kernel, {"amp_dispersion": "double"}, ["row", "col"])


def select_ps(dispersion: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Pixels up to the threshold (inclusive), most stable first, ties by row and column."""
    return dispersion.where(F.col("amp_dispersion") <= threshold).orderBy("amp_dispersion", "row", "col")
