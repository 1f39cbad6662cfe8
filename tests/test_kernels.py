import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanforge.functions import kernels as K

CURVE = [0, 2, 5, 4, 4.5, 1, 0, 3, 7, 7, 6, 6.5, 2, 0]


def test_peaks_of_curve_and_plateaus():
    assert K.local_peaks(np.array(CURVE)).tolist() == [2, 4, 8, 11]
    assert K.local_peaks(np.array([0, 1, 2, 2, 2, 1, 0.0])).tolist() == [3]
    assert K.local_peaks(np.array([0, 2, 2.0])).tolist() == []
    assert K.local_peaks(np.array([])).tolist() == []


def brute_prominence(y, p):
    left = p
    while left > 0 and y[left - 1] <= y[p]:
        left -= 1
    right = p
    while right < len(y) - 1 and y[right + 1] <= y[p]:
        right += 1
    return y[p] - max(min(y[left : p + 1]), min(y[p : right + 1]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40))
def test_prominences_and_widths(values):
    y = np.array(values, float)
    found = K.find_peaks(y)
    for p, prom, w, left, right in zip(*(found[k] for k in ("peaks", "prominences", "widths", "left_ips", "right_ips")), strict=True):
        assert prom == brute_prominence(y, p)
        assert left <= p <= right and w == right - left
        assert np.interp(left, np.arange(len(y)), y) == pytest.approx(y[p] - prom / 2)


def test_spectrum_peak_bounds_and_sum():
    y = [0, 1, 4, 8, 4, 1, 0]
    found = K.spectrum_peaks(np.arange(7) * 0.5, y)
    assert found["apex_mz"].tolist() == [1.5]
    a, b = int(found["start_mzidx"][0]), int(found["end_mzidx"][0])
    assert found["peak_intensity_sum"][0] == sum(y[a : b + 1])
    assert found["peak_height"][0] == 2.0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000), st.floats(0, 2))
def test_lasso_meets_its_conditions(n, seed, alpha):
    rng = np.random.default_rng(seed)
    d = rng.random((12, n))
    c, g = d.T @ rng.random(12), d.T @ d
    a = K.nonnegative_lasso(g, c, alpha, most=20_000, tol=1e-12)
    slope = g @ a - c + alpha
    assert (a >= 0).all()
    assert (slope >= -1e-6).all() and np.abs(slope[a > 1e-9]).max(initial=0) < 1e-6


def test_lasso_small_and_threshold():
    g, c = np.diag([1.0, 4.0]), np.array([3.0, -1.0])
    assert K.nonnegative_lasso(g, c).tolist() == [3, 0]
    assert K.nonnegative_lasso(g, c, 1).tolist() == [2, 0]
    d = np.array([[0.6], [0.3], [0.1]])
    assert K.encode([10, 4, 0], d)[0] == pytest.approx(7.2)
    assert K.encode([10, 4, 0], d, 0.2)[0] == pytest.approx(7.0)
    with pytest.raises(ValueError):
        K.encode([1.0], np.ones((1, 1)), algorithm="ridge")


def test_alpha_path():
    d, y = np.eye(2), np.array([3.0, 1.0])
    assert K.choose_alpha(y, d, [], "threshold")[0] == 0.0
    assert K.choose_alpha(y, d, [0.5, 2.0], "lasso_cd", criteria="min")[0] == 0.0
    assert K.choose_alpha(y, d, [0.5, 2.0], "lasso_cd", criteria="convergence")[0] == 0.0


def test_trapezoid_elution_and_repair():
    assert K.trapezoid([2, 4, 0], [0, 1, 3]) == 7
    act = [0, 0, 5, 9, 5, 0, 0, 3, 6, 3, 0]
    found = K.elution_peaks(act, np.arange(11.0), center=8.2)
    assert found["apex"].tolist() == [3, 8]
    assert found["closest_to_search_center"].tolist() == [False, True]
    assert K.elution_peaks([0, 9, 0], np.arange(3.0), 1.0)["apex"].tolist() == [1]
    fixed = K.repair_minima([0, 9e4, 9e4, 0, 9e4, 9e4, 0])
    assert fixed[3] == 9e4 and fixed[1] == 9e4


def test_composition_and_isotopes():
    assert K.composition("_GG_", 1) == {"C": 4, "H": 9, "N": 2, "O": 3, "S": 0}
    cam = K.composition("_C_", 1)
    assert cam == {"C": 5, "H": 11, "N": 2, "O": 3, "S": 1}
    mz, p = K.isotope_pattern("_PEPTIDEM(ox)K_", 2, 0.001)
    assert (np.diff(mz) > 0).all() and 0.95 < p.sum() <= 1 and p.argmax() == 0
    brute = math.exp(sum(n * math.log(K.ISOTOPES[e][0][1]) for e, n in K.composition("_PEPTIDEM(ox)K_", 2).items()))
    assert p[0] == pytest.approx(brute)


def test_cross_validation_prefers_the_true_scale():
    rng = np.random.default_rng(0)
    d = rng.random((80, 3))
    y = d @ np.array([2.0, 0.0, 1.0]) + rng.normal(0, 0.01, 80)
    best, errors = K.cross_validate(y, d, [0.0, 0.01, 100.0], 5)
    assert best in (0.0, 0.01) and errors[2] > 10 * errors.min()
