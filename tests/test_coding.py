from itertools import combinations

import numpy as np
import pytest

from scanforge.functions import coding, kernels
from scanforge.operators import solve


def systems(n_trials, seed=0, columns=10):
    """Small systems: positive and mixed, with equal, dependent, empty and rounded columns."""
    rng = np.random.default_rng(seed)
    for trial in range(n_trials):
        m, n = rng.integers(2, 13), rng.integers(1, columns)
        d = np.abs(rng.normal(size=(m, n))) if trial % 3 else rng.normal(size=(m, n))
        if trial % 4 == 0 and n > 2:
            d[:, 1] = d[:, 0]
        if trial % 5 == 0 and n > 3:
            d[:, 2] = (d[:, 0] + d[:, 3]) / 2
        if trial % 7 == 0:
            d = np.round(d)
        if trial % 11 == 0:
            d[:, 0] = 0
        yield d, rng.normal(size=m) + d @ np.maximum(rng.normal(size=n), 0)


def test_path_equals_coordinate_descent_at_every_alpha():
    for d, y in systems(200):
        g, c = d.T @ d, d.T @ y
        knots, values = coding.lasso_path(g, c)
        assert (np.diff(knots) < 0).all() and (values >= 0).all()
        for alpha in [0, 0.001, 0.05, 0.5, 1, 3, *knots, *(knots[1:] + knots[:-1]) / 2]:
            a, b = coding.read_path(knots, values, alpha), kernels.nonnegative_lasso(g, c, alpha, most=200_000, tol=1e-13)
            cost = lambda x: x @ g @ x / 2 - c @ x + alpha * x.sum()  # noqa: E731, B023
            assert cost(a) <= cost(b) + 1e-8 * max(1, abs(cost(b)))
            if np.linalg.matrix_rank(d) == d.shape[1] and np.linalg.cond(d) < 100:
                assert np.abs(a - b).max() < 1e-6


def test_the_path_ends_at_least_and_at_nothing():
    g, c = np.diag([1.0, 4.0]), np.array([3.0, 2.0])
    knots, values = coding.lasso_path(g, c)
    assert knots.tolist() == [3, 2, 0] and values.tolist() == [[0, 0], [1, 0], [3, 0.5]]
    assert coding.lasso_path(g, c, 2.5)[0].tolist() == [3, 2.5] and coding.lasso_path(g, -c)[1].tolist() == [[0, 0]]
    assert coding.lasso_path(np.zeros((0, 0)), np.zeros(0))[1].shape == (1, 0)
    assert coding.read_steps(values, 1).tolist() == [1, 0] and coding.read_steps(values, 0).tolist() == [3, 0.5]


def best_fit(d, y, columns):
    """Non-negative least squares by trying all sets of active columns."""
    best = (y @ y, np.zeros(d.shape[1]))
    for k in range(1, len(columns) + 1):
        for own in combinations(columns, k):
            x, *_ = np.linalg.lstsq(d[:, own], y, rcond=None)
            if (x > 0).all():
                left = y - d[:, own] @ x
                if left @ left < best[0] - 1e-12:
                    a = np.zeros(d.shape[1])
                    a[list(own)] = x
                    best = (left @ left, a)
    return best[1]


def test_pursuit_equals_brute_force():
    checked = 0
    for d, y in systems(250, 3, 7):
        length = np.sqrt((d * d).sum(axis=0))
        if np.linalg.matrix_rank(d) < d.shape[1]:
            continue
        for most in (1, 2, 3):
            active, a = [], np.zeros(d.shape[1])
            while len(active) < most:
                score = np.where([j in active for j in range(len(a))], -np.inf, d.T @ (y - d @ a) / length)
                if not score.max() > 1e-9 * (d.T @ y / length).max():
                    break
                a = best_fit(d, y, [*active, int(score.argmax())])
                active = np.flatnonzero(a).tolist()
            got = coding.nonnegative_pursuit(d.T @ d, d.T @ y, most)
            assert np.allclose(got, a, atol=1e-8) and (got > 0).sum() <= most
            checked += 1
    assert checked > 300


def test_pursuit_of_any_number_is_the_nonnegative_fit():
    for d, y in systems(60, 8, 7):
        a = coding.nonnegative_pursuit(d.T @ d, d.T @ y)
        b = kernels.nonnegative_lasso(d.T @ d, d.T @ y, 0, most=200_000, tol=1e-13)
        left = lambda x: ((y - d @ x) ** 2).sum()  # noqa: E731, B023
        assert left(a) <= left(b) + 1e-7 * max(1.0, left(b))


def test_algorithms_of_a_scan(spark):
    rng = np.random.default_rng(5)
    rows, seen = [], []
    for scan in range(6):
        d = np.abs(rng.normal(size=(8, 4)))
        y = d @ [2.0, 0, 1.0, 0] + rng.random(8) * 0.1
        rows += [(scan, float(i), 10 + j, float(d[i, j])) for i in range(8) for j in range(4)]
        seen += [(scan, float(i), float(y[i])) for i in range(8)]
    dictionary, observed = spark.createDataFrame(rows, "scan_idx long, apex_mz double, id long, abundance double"), spark.createDataFrame(seen, "scan_idx long, apex_mz double, intensity double")
    act = lambda algorithm, *alphas: {(r.scan_idx, r.id): r.activation for r in solve.lasso_activation(dictionary, observed, list(alphas), algorithm).collect()}
    assert act("lasso_lars", 0.1, 0.5) == pytest.approx(act("lasso_cd", 0.1, 0.5), abs=1e-6)
    two = act("omp", 2.0)
    assert all(sum(two[s, 10 + j] > 0 for j in range(4)) >= 2 for s in range(6))
    path = solve.lasso_path(dictionary, observed)
    for alpha in (0.0, 0.2, 1.0, 50.0):
        got = {(r.scan_idx, r.id): r.activation for r in solve.activation_at(path, alpha).collect()}
        for s in range(6):
            y, d = np.array([v for i, _, v in seen if i == s]), np.array([v for i, _, _, v in rows if i == s]).reshape(8, 4)
            want = kernels.nonnegative_lasso(d.T @ d, d.T @ y, alpha, most=100_000, tol=1e-13)
            assert [got.get((s, 10 + j), 0.0) for j in range(4)] == pytest.approx(want, abs=1e-6)
    assert solve.activation_at(path, 0.2, 0.3).select("alpha").distinct().count() == 2
    with pytest.raises(ValueError):
        kernels.encode(np.ones(2), np.ones((2, 1)), 0.0, "ridge")


def test_lars_stops_before_more_columns_are_active():
    d = np.array([[3.0, 0, 0], [0, 2, 0], [0, 0, 1]])
    y = np.array([5.0, 5, 5])
    assert (kernels.encode(y, d, 1, "lars") > 0).tolist() == [True, False, False] and (kernels.encode(y, d, 2, "lars") > 0).tolist() == [True, True, False]
    assert kernels.encode(y, d, 1, "omp") == pytest.approx([5 / 3, 0, 0]) and kernels.encode(y, d, 0, "omp") == pytest.approx([5 / 3, 2.5, 5])
