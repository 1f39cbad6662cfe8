"""Greedy and path solutions of the non-negative sparse system of one scan, in numpy.

With G = D'D and c = D'y: a pursuit adds one column at a time, the path follows the non-negative lasso
from the largest penalty down to none. Both keep the inverse of the Cholesky factor of the active
columns and let it grow by one row a step.
"""

from __future__ import annotations

import numpy as np

#: A column whose part beyond the active ones has a smaller share of its square depends on them.
DEPENDENT = 1e-10


class Factor:
    """Inverse Cholesky factor of ``gram`` over a growing list of columns."""

    def __init__(self, gram: np.ndarray):
        self.gram, self.columns, self.inverse = gram, [], np.zeros((0, 0))

    def add(self, j: int) -> bool:
        """False, and nothing added, if column ``j`` depends on those that are there."""
        k = len(self.columns)
        w = self.inverse @ self.gram[self.columns, j]
        rest = self.gram[j, j] - w @ w
        if rest <= DEPENDENT * self.gram[j, j]:
            return False
        new = np.zeros((k + 1, k + 1))
        new[:k, :k] = self.inverse
        new[k, :k], new[k, k] = -(w @ self.inverse) / np.sqrt(rest), 1 / np.sqrt(rest)
        self.inverse = new
        self.columns.append(j)
        return True

    def drop(self, j: int) -> None:
        left = [i for i in self.columns if i != j]
        self.columns, self.inverse = [], np.zeros((0, 0))
        for i in left:
            self.add(i)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """x with G x = b over the columns, in their order."""
        return self.inverse.T @ (self.inverse @ b[self.columns])


def nonnegative_pursuit(gram, projection, most: int | None = None, tol: float = 1e-9) -> np.ndarray:
    """Orthogonal matching pursuit with activations of at least 0.

    Each step takes the column with the greatest positive correlation with what is left, over its own length (ties: the first), and
    then fits all taken columns by non-negative least squares; one that the fit puts at 0 is given back. It ends at ``most``
    columns (None or 0: any number), when no correlation exceeds ``tol`` of the first, or when a step gives back what it took.
    """
    g, c = np.asarray(gram, float), np.asarray(projection, float)
    n = len(c)
    length = np.sqrt(np.maximum(np.diag(g), 0))
    usable = length > 0
    a, factor = np.zeros(n), Factor(g)
    score = np.where(usable, c / np.where(usable, length, 1), -np.inf)
    enough = tol * max(float(score.max(initial=0.0)), 0.0)
    refused = np.zeros(n, bool)
    while len(factor.columns) < (most or n):
        left = np.where(usable & ~refused, (c - g @ a) / np.where(usable, length, 1), -np.inf)
        left[factor.columns] = -np.inf
        j = int(left.argmax()) if n else 0
        if not n or not left[j] > enough:
            break
        if not factor.add(j):
            refused[j] = True
            continue
        before = set(factor.columns)
        _nonnegative_fit(factor, c, a)
        if j not in factor.columns:
            refused[j] = True
        elif before != set(factor.columns):
            refused[:] = False
    return a


def _nonnegative_fit(factor: Factor, c: np.ndarray, a: np.ndarray) -> None:
    """Moves ``a`` to the least squares fit on the factor's columns; columns that would turn negative leave on the way."""
    while factor.columns:
        own = np.array(factor.columns)
        target = factor.solve(c)
        if (target > 0).all():
            a[:] = 0
            a[own] = target
            return
        down = target <= 0
        share = a[own[down]] / np.maximum(a[own[down]] - target[down], 1e-300)
        step = float(share.min())
        a[own] = a[own] + step * (target - a[own])
        for j in own[down][share <= step * (1 + 1e-12)].tolist():
            a[j] = 0
            factor.drop(j)
    a[:] = 0


def lasso_path(gram, projection, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots (falling penalties) and activations (knots x columns) of the non-negative lasso down to the penalty ``least``.

    Between knots activations are straight lines, above the first knot all are 0. Columns join where their correlation with what is left reaches
    the penalty and leave where they reach 0. Of columns that depend on active ones none joins while that is so.
    """
    g, c = np.asarray(gram, float), np.asarray(projection, float)
    n = len(c)
    usable = np.diag(g) > 0
    start = float(np.where(usable, c, -np.inf).max(initial=-np.inf))
    if not start > least:
        return np.array([max(least, 0.0)]), np.zeros((1, n))
    factor, now, a = Factor(g), start, np.zeros(n)
    knots, values = [now], [a.copy()]
    refused, left_at = np.zeros(n, bool), np.full(n, np.inf)
    eps = 1e-11 * max(start, 1e-300)
    factor.add(int(np.where(usable, c, -np.inf).argmax()))
    for _ in range(50 * n + 100):
        own = np.array(factor.columns, np.int64)
        u, v = factor.solve(c), factor.solve(np.ones(n))
        p, q = c - g[:, own] @ u, g[:, own] @ v
        # The gap between penalty and correlation of a column outside closes where penalty * (1 - q) = p.
        out = usable & ~refused
        out[own] = False
        closing = out & (1 - q > 1e-12)
        join = np.full(n, -np.inf)
        join[closing] = np.minimum(p[closing] / (1 - q[closing]), now)
        join[closing & (left_at <= now + eps) & (join >= now - eps)] = -np.inf
        leave = np.full(len(own), -np.inf)
        falling = v < -1e-14
        leave[falling] = np.minimum(u[falling] / v[falling], now)
        next_join = float(join.max(initial=-np.inf))
        next_leave = float(leave.max(initial=-np.inf))
        to = max(next_join, next_leave, least)
        a = np.zeros(n)
        a[own] = np.maximum(u - to * v, 0)
        if to < now - eps:
            knots.append(to)
            values.append(a.copy())
            left_at[:] = np.inf
        now = to
        if to <= least:
            break
        if next_leave >= next_join:
            j = int(own[int(leave.argmax())])
            values[-1][j] = 0
            factor.drop(j)
            left_at[j] = now
            refused[:] = False
        elif not factor.add(int(join.argmax())):
            refused[int(join.argmax())] = True
        if not factor.columns:
            join = np.where(usable, c, -np.inf)
            join[left_at <= now + eps] = -np.inf
            factor.add(int(join.argmax()))
    else:
        raise ArithmeticError("the path did not reach its end")
    return np.array(knots), np.array(values)


def read_path(knots: np.ndarray, values: np.ndarray, alpha: float) -> np.ndarray:
    """Activations at a penalty of the path."""
    if alpha >= knots[0]:
        return np.zeros(values.shape[1])
    i = int(np.searchsorted(-knots, -alpha, side="right"))
    if i >= len(knots):
        return values[-1].copy()
    share = (knots[i - 1] - alpha) / (knots[i - 1] - knots[i])
    return values[i - 1] + share * (values[i] - values[i - 1])


def read_steps(values: np.ndarray, most: int) -> np.ndarray:
    """Activations at the last knot of the path before more than ``most`` columns are active (0: at its end)."""
    active = (values > 0).sum(axis=1)
    over = np.flatnonzero(active > most)
    return values[-1 if not most or not len(over) else max(int(over[0]) - 1, 0)].copy()
