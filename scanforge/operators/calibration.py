"""Calibration of predicted on measured times, one curve a run.

A run's predictions are cut into cells of equal width. Each row adds to a few power sums of
its cell, so one aggregation with map-side sums holds all that either curve needs: a smoothing cubic
spline (its normal equations are sums of powers up to the sixth) or a monotone line through cell means. Curves come back as one row a run and are
applied by one join and an array access.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 50
SUMS = ["n", *(f"u{i}" for i in range(1, 7)), *(f"t{i}" for i in range(4)), "yy", "x"]
PIECE = "struct<split:double,low:array<double>,high:array<double>>"
#: The four uniform cubic B-splines on a cell as polynomials, constant first.
BASIS = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _place(x: Column, low: Column, high: Column, cells: Column) -> tuple[Column, Column]:
    """The cell of a value, the outer ones reaching to infinity, and its place in it, 0 to 1 inside."""
    width = F.when(high > low, (high - low) / cells).otherwise(1.0)
    at = (x - low) / width
    cell = F.greatest(F.least(F.floor(at), (cells - 1).cast("long")), F.lit(0))
    return cell, at - cell


def cell_sums(df: DataFrame, predicted: str, measured: str, by: list[str] = (), cells: int = CELLS) -> DataFrame:
    """``(*by, low, high, cell)`` and the sums of the rows of each cell that has any.

    ``u1`` to ``u6`` are sums of powers of the place in the cell, ``t0`` to ``t3`` of its powers times the measured time. Rows without
    a finite pair are left out; a null in ``by`` is a run of its own.
    """
    rows = df.where(_finite(predicted) & _finite(measured)).select(*by, F.col(predicted).cast("double").alias("_x"), F.col(measured).cast("double").alias("_y"))
    bounds = rows.groupBy(*by).agg(F.min("_x").alias("low"), F.max("_x").alias("high"))
    if by:
        known = bounds.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), "low", "high")
        same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
        rows = rows.join(known, same).drop(*(f"_{i}" for i in range(len(by))))
    else:
        rows = rows.crossJoin(F.broadcast(bounds))  # one row
    cell, u = _place(F.col("_x"), F.col("low"), F.col("high"), F.lit(cells))
    placed = rows.select(*by, "low", "high", "_x", "_y", cell.alias("cell"), u.alias("_u"))
    u, y = F.col("_u"), F.col("_y")
    power = [F.lit(1.0), u, u * u, u * u * u]
    sums = [F.count("*").cast("double").alias("n"), *(F.sum(p).alias(f"u{i}") for i, p in enumerate([u, u * u, u * u * u, u * u * u * u, u * u * u * u * u, u * u * u * u * u * u], 1))]
    sums += [F.sum(y * p).alias(f"t{i}") for i, p in enumerate(power)]
    return placed.groupBy(*by, "low", "high", "cell").agg(*sums, F.sum(y * y).alias("yy"), F.sum("_x").alias("x"))


# --- curves of one run ---------------------------------------------------------------------------------


def spline_system(cell: np.ndarray, u: np.ndarray, t: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """B'B and B'y of the cubic B-splines from power sums: ``u`` cells x 7 powers, ``t`` cells x 4."""
    a, b = np.zeros((cells + 3, cells + 3)), np.zeros(cells + 3)
    hankel = np.add.outer(np.arange(4), np.arange(4))
    for c, own_u, own_t in zip(cell.tolist(), u, t, strict=True):
        a[c : c + 4, c : c + 4] += BASIS @ own_u[hankel] @ BASIS.T
        b[c : c + 4] += BASIS @ own_t
    return a, b


def fit_spline(a: np.ndarray, b: np.ndarray, yy: float, n: float, smooth: float | None, increasing: bool, base: np.ndarray) -> np.ndarray:
    """Coefficients with penalised second differences, about the line with coefficients ``base``.

    Without ``smooth`` the strength with the least generalised cross-validation error is taken. ``increasing`` adds
    a heavy penalty on coefficients that fall until none does, so the curve never falls.
    """
    k = len(b)
    second, first = np.diff(np.eye(k), 2, axis=0), np.diff(np.eye(k), axis=0)
    rough, steady = second.T @ second, 1e-9 * max(np.trace(a), 1.0) / k * (first.T @ first)

    def solve(strength, more=np.zeros((k, k))):
        return base + np.linalg.solve(a + strength * rough + steady + more, b - (a + more) @ base)

    def error(strength):
        c = solve(strength)
        left = max(yy - 2 * c @ b + c @ a @ c, 0.0)
        used = np.trace(np.linalg.solve(a + strength * rough + steady, a))
        return n * left / max(n - used, 1e-9) ** 2

    if smooth is None:
        scale = max(np.trace(a), 1e-12) / k
        smooth = min((scale * s for s in 10.0 ** np.arange(-6, 7)), key=error)
    c = solve(smooth)
    if increasing:
        heavy = 1e6 * max(np.trace(a), 1.0)
        falls = np.zeros(k - 1, bool)
        for _ in range(50):
            now = np.diff(c) < -1e-12 * max(np.abs(c).max(), 1.0)
            if not (now & ~falls).any():
                break
            falls |= now
            c = solve(smooth, heavy * first[falls].T @ first[falls])
        c = np.maximum.accumulate(c)
    return c


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The never falling values nearest to ``y`` in weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, m, k = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * m) / (last[1] + m)
            last[1], last[2] = last[1] + m, last[2] + k
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def monotone_pieces(cell: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, low: float, width: float, cells: int) -> list[dict]:
    """For each cell the two lines that meet in its knot, by place in the cell; one line where it has none. A single knot shifts all."""
    knot_x, knot_y = x / n, pool_adjacent(y / n, n)
    order = np.argsort(cell)
    if len(cell) == 1:
        slope, start = np.ones(1), knot_x
    else:
        slope, start = np.diff(knot_y[order]) / np.diff(knot_x[order]), knot_x[order]
    value = knot_y[order]

    def line(i: int, c: int) -> list[float]:
        i = min(max(i, 0), len(slope) - 1)
        return [float(value[i] + slope[i] * (low + c * width - start[i])), float(slope[i] * width), 0.0, 0.0]

    out, known = [], dict(zip(cell.tolist(), range(len(cell)), strict=True))
    for c in range(cells):
        i = int(np.searchsorted(cell, c))
        if c in known:
            out.append({"split": float((start[i] - low) / width - c), "low": line(i - 1, c), "high": line(i, c)})
        else:
            out.append({"split": -1e300, "low": line(i - 1, c), "high": line(i - 1, c)})
    return out


def spline_pieces(c: np.ndarray, cells: int) -> list[dict]:
    both = [(c[j : j + 4] @ BASIS).tolist() for j in range(cells)]
    return [{"split": -1e300, "low": p, "high": p} for p in both]


# --- tables ------------------------------------------------------------------------------------------------


def fit_calibration(df: DataFrame, predicted: str = "predicted_RT", measured: str = "Calibrated retention time", by: list[str] = (), method: str = "spline", cells: int = CELLS, smooth: float | None = None, increasing: bool = True) -> DataFrame:
    """``(*by, low, high, cells, pieces)``, one row a run: the curve from predicted to measured times.

    ``spline`` is a smoothing cubic spline, by default one that never falls; ``monotone`` goes through the means of the
    cells, pooled where they fall. A run of one point is shifted. A run's task sees one row a cell.
    """
    if method not in ("spline", "monotone"):
        raise ValueError(f"unknown method {method}")
    sums = cell_sums(df, predicted, measured, by, cells)
    if not by:
        sums = sums.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell")
        col = {c: t.column(c).to_numpy() for c in ("cell", *SUMS)}
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        width = (high - low) / cells if high > low else 1.0
        if method == "monotone":
            pieces = monotone_pieces(col["cell"], col["n"], col["x"], col["t0"], low, width, cells)
        else:
            a, b = spline_system(col["cell"], np.stack([col[c] for c in ("n", *SUMS[1:7])], 1), np.stack([col[f"t{i}"] for i in range(4)], 1), cells)
            shift = (col["t0"].sum() - col["x"].sum()) / col["n"].sum()
            base = low + shift + width * (np.arange(cells + 3) - 1)
            pieces = spline_pieces(fit_spline(a, b, col["yy"].sum(), col["n"].sum(), smooth, increasing, base), cells)
        kind = pa.list_(pa.struct([("split", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([low]), pa.array([high]), pa.array([cells], pa.int32()), pa.array([pieces], kind)], [*keys, "low", "high", "cells", "pieces"])

    schema = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    out = sums.groupBy(*keys).applyInArrow(fit, f"{schema}, low double, high double, cells int, pieces array<{PIECE}>")
    return out if by else out.drop("_all")


def apply_calibration(df: DataFrame, curves: DataFrame, predicted: str = "predicted_RT", by: list[str] = (), out: str = "calibrated_RT") -> DataFrame:
    """``df`` with ``out``, the curve of its run at ``predicted``; beyond the fitted range the curve goes on straight.

    Null where the prediction is null or the run has no curve.
    """
    names = [f"_c_{c}" for c in (*by, "low", "high", "cells", "pieces")]
    renamed = curves.select(*by, "low", "high", "cells", "pieces").toDF(*names)
    if by:
        joined = df.join(renamed, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by], "left")
    else:
        joined = df.join(F.broadcast(renamed), F.lit(True), "left")  # one row
    cell, u = _place(F.col(predicted).cast("double"), F.col("_c_low"), F.col("_c_high"), F.col("_c_cells"))
    placed = joined.withColumn("_c_at", F.get("_c_pieces", cell.cast("int"))).withColumn("_c_u", u)
    inside = F.least(F.greatest(F.col("_c_u"), F.lit(0.0)), F.lit(1.0))
    poly = F.when(F.col("_c_u") < F.col("_c_at.split"), F.col("_c_at.low")).otherwise(F.col("_c_at.high"))
    p = [F.get("_c_p", F.lit(i)) for i in range(4)]
    value = p[0] + inside * (p[1] + inside * (p[2] + inside * p[3]))
    slope = p[1] + inside * (2 * p[2] + 3 * inside * p[3])
    done = placed.withColumn("_c_p", poly).withColumn(out, value + slope * (F.col("_c_u") - inside))
    return done.drop(*names, "_c_at", "_c_u", "_c_p")
