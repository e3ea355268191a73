from datetime import date

import numpy as np
import pytest

from fringeflow import arrays as A
from fringeflow.functions.phase import WAVELENGTH_M
from fringeflow.operators.cube import every
from fringeflow.operators.features import FeatureConfig, names

EPOCHS = every(date(2020, 1, 1), 12, 4)
PAIRS = [(0, 1), (1, 2), (2, 3), (0, 2), (1, 3)]
T = np.array([(e - EPOCHS[0]).days / 365.25 for e in EPOCHS])
DISP = -0.05 * T[:, None, None] * np.ones((4, 2, 3))
PHASE = np.stack([-4 * np.pi / WAVELENGTH_M * (DISP[s] - DISP[r]) for r, s in PAIRS])


def test_inversion_velocity_and_coherence(spark):
    phase = PHASE.copy()
    phase[3, 0, 0] = np.nan
    phase[[2, 4], 1, 1] = np.nan
    got = A.invert_sbas(spark, phase, PAIRS, EPOCHS)["displacement"]
    assert np.isnan(got[:, 1, 1]).all() and np.allclose(np.delete(got.reshape(4, -1), 4, axis=1), np.delete(DISP.reshape(4, -1), 4, axis=1), atol=1e-5)
    assert np.allclose(A.estimate_velocity(spark, DISP, EPOCHS), -0.05, atol=1e-6) and np.allclose(A.estimate_velocity_uncertainty(spark, DISP, EPOCHS), 0, atol=1e-9)
    assert np.allclose(A.temporal_coherence(spark, PHASE, DISP, PAIRS, EPOCHS), 1)
    assert np.nanmax(np.abs(A.invert_sbas(spark, PHASE, [(*p, b) for p, b in zip(PAIRS, [50, -30, 80, -20, 60], strict=True)], EPOCHS, dem_range_m=850e3)["dem_error"])) < 0.05
    with pytest.raises(ValueError):
        A.invert_sbas(spark, PHASE[:3], PAIRS, EPOCHS)
    with pytest.raises(ValueError):
        A.estimate_velocity(spark, DISP, EPOCHS[:2])


def test_amplitudes(spark):
    got = A.amplitude_dispersion(spark, np.array([1.0, 2, 3])[:, None, None])
    assert got[0, 0] == pytest.approx(0.5)
    amp = np.array([2.0, 4, 4, 6])[:, None, None] * np.ones((4, 1, 3))
    amp[0, 0, 1], amp[:, 0, 2] = np.nan, 0
    got = A.amplitude_dispersion(spark, amp)
    assert got[0, 0] == pytest.approx(np.sqrt(8 / 3) / 4) and np.isnan(got[0, 1:]).all()


def test_maps(spark):
    r, c = np.indices((5, 6))
    mask = np.ones((5, 6), bool)
    mask[0, 0] = False
    values = 3.0 * c - 2 * r + 1
    values[0, 0] += 9
    got = A.remove_ramp(spark, values, mask=mask)
    assert got[0, 0] == pytest.approx(9, abs=1e-6) and np.abs(got).sum() == pytest.approx(9, abs=1e-6)
    i, h = [np.full((5, 6), 39.0)] * 2, [np.full((5, 6), x) for x in (-12.0, -168.0)]
    up, east = A.decompose_per_pixel(spark, [values, values], i, h)
    both = A.decompose_asc_desc(spark, values, values, (39, -12), (39, -168))
    assert np.allclose(up, both[0]) and np.allclose(east, both[1])


def test_features_and_closure(spark):
    got = A.extract_features(spark, DISP, EPOCHS, FeatureConfig(False, False, 3))
    assert list(got) == names(FeatureConfig(False, False)) and np.allclose(got["velocity"], -0.05) and np.allclose(got["linearity_r2"], 1)
    full = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    phase = np.stack([(s - r) * np.ones((1, 2)) for r, s in full]).astype(float)
    bad = phase.copy()
    bad[0, 0, 0] += 2 * np.pi
    fixed, done, left = A.correct_unwrap_errors(spark, bad, full)
    assert (done, left) == (1, 0) and np.allclose(fixed, phase)
    assert A.correct_unwrap_errors(spark, phase[[0, 3, 5]], [(0, 1), (1, 2), (2, 3)])[1:] == (0, 0)
