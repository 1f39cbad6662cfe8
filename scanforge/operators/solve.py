"""Activations of candidates per spectrum, and how well they explain it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions import coding, kernels


def threshold_activation(dictionary: DataFrame, observed: DataFrame, alpha: float = 0.0) -> DataFrame:
    """``(scan_idx, id, activation)``: the observation projected on each candidate, less ``alpha``, at least 0.

    The default solver; one join and one sum, all in the JVM.
    """
    both = dictionary.join(observed, ["scan_idx", "apex_mz"])
    total = F.sum(F.col("abundance") * F.col("intensity"))
    return both.groupBy("scan_idx", "id").agg(F.greatest(total - alpha, F.lit(0.0)).alias("activation"))


def gram(dictionary: DataFrame) -> DataFrame:
    """``(scan_idx, a, b, g)``: inner products of candidates that share a row, a <= b."""
    a = dictionary.select("scan_idx", "apex_mz", F.col("id").alias("a"), F.col("abundance").alias("x"))
    b = dictionary.select("scan_idx", "apex_mz", F.col("id").alias("b"), F.col("abundance").alias("y"))
    return a.join(b, ["scan_idx", "apex_mz"]).where("a <= b").groupBy("scan_idx", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))


def lasso_activation(dictionary: DataFrame, observed: DataFrame, alphas: list[float] = (), algorithm: str = "lasso_cd", loss: str = "lasso", preprocessing: str = "raw", criteria: str = "min", metric: str = "cos_dist") -> DataFrame:
    """``(scan_idx, id, activation, alpha, score)`` of the best alpha of each scan's path.

    A scan's small matrix is built inside one task; scans are spread by ``scan_idx``.
    ``preprocessing="sqrt"`` fits square roots and squares the activations.
    """
    if preprocessing not in ("raw", "sqrt"):
        raise ValueError(f"unknown preprocessing {preprocessing}")
    rows = _systems(dictionary, observed)

    def solve(t: pa.Table) -> pa.Table:
        y, d, names = _matrix(t)
        if preprocessing == "sqrt":
            y, d = np.sqrt(y), np.sqrt(d)
        alpha, a, score = kernels.choose_alpha(y, d, list(alphas), algorithm, loss, criteria, metric) if len(names) else (0.0, np.zeros(0), float("nan"))
        if preprocessing == "sqrt":
            a = a * a
        scan = t.column("scan_idx")[0].as_py()
        n = len(names)
        return pa.table({"scan_idx": pa.array([scan] * n, pa.int64()), "id": pa.array(names, pa.int64()), "activation": pa.array(a, pa.float64()), "alpha": pa.array([alpha] * n, pa.float64()), "score": pa.array([score] * n, pa.float64())})

    return rows.groupBy("scan_idx").applyInArrow(solve, "scan_idx long, id long, activation double, alpha double, score double")


def lasso_path(dictionary: DataFrame, observed: DataFrame, least: float = 0.0) -> DataFrame:
    """``(scan_idx, id, alphas, activations)``: all knots of a scan's non-negative lasso path, and a candidate's activation at each.

    One pass over a scan gives every alpha from the largest down to ``least``; :func:`activation_at` reads them. Candidates that are never active
    are left out. A scan's small matrix is built inside one task.
    """
    rows = _systems(dictionary, observed)

    def follow(t: pa.Table) -> pa.Table:
        y, d, names = _matrix(t)
        knots, values = coding.lasso_path(d.T @ d, d.T @ y, least) if len(names) else (np.zeros(1), np.zeros((1, 0)))
        on = np.flatnonzero((values > 0).any(axis=0))
        return pa.table(
            {
                "scan_idx": pa.array([t.column("scan_idx")[0].as_py()] * len(on), pa.int64()), "id": pa.array(names[on], pa.int64()),
                "alphas": pa.array([knots] * len(on), pa.list_(pa.float64())), "activations": pa.array(list(values[:, on].T), pa.list_(pa.float64())),
            }
        )

    return rows.groupBy("scan_idx").applyInArrow(follow, "scan_idx long, id long, alphas array<double>, activations array<double>")


def pursuit_activation(dictionary: DataFrame, observed: DataFrame, most: int = 0) -> DataFrame:
    """``(scan_idx, id, activation)`` of the at most ``most`` (0: any number) candidates that a non-negative pursuit takes in each scan."""
    rows = _systems(dictionary, observed)

    def pursue(t: pa.Table) -> pa.Table:
        y, d, names = _matrix(t)
        a = coding.nonnegative_pursuit(d.T @ d, d.T @ y, most)
        on = np.flatnonzero(a > 0)
        return pa.table({"scan_idx": pa.array([t.column("scan_idx")[0].as_py()] * len(on), pa.int64()), "id": pa.array(names[on], pa.int64()), "activation": pa.array(a[on], pa.float64())})

    return rows.groupBy("scan_idx").applyInArrow(pursue, "scan_idx long, id long, activation double")


def activation_at(path: DataFrame, *alphas: float) -> DataFrame:
    """``(scan_idx, id, alpha, activation)`` at each alpha, read from a path by array functions; inactive candidates are left out."""
    rows = path.select("*", F.explode(F.array(*(F.lit(float(a)) for a in alphas))).alias("alpha"))
    i = F.size(F.filter("alphas", lambda k: k > F.col("alpha")))
    k0, k1 = F.get("alphas", F.col("_i") - 1), F.get("alphas", F.col("_i"))
    a0, a1 = F.get("activations", F.col("_i") - 1), F.get("activations", F.col("_i"))
    value = F.when(F.col("_i") == 0, 0.0).when(k1.isNull(), a0).otherwise(a0 + (k0 - F.col("alpha")) / (k0 - k1) * (a1 - a0))
    return rows.withColumn("_i", i).select("scan_idx", "id", "alpha", value.alias("activation")).where("activation > 0")


def cross_validated_alpha(dictionary: DataFrame, observed: DataFrame, alphas: list[float], folds: int = 10, algorithm: str = "lasso_cd", seed: int = 0) -> DataFrame:
    """``(scan_idx, alpha, error, best)``: each alpha's mean squared error over held-out rows of a scan; ``best`` has the least.

    Rows of a scan are dealt over folds in order of their place, by a permutation that ``seed`` sets.
    """
    rows = _systems(dictionary, observed)

    def validate(t: pa.Table) -> pa.Table:
        y, d, _ = _matrix(t)
        best, errors = kernels.cross_validate(y, d, list(alphas), folds, algorithm, seed)
        n = len(alphas)
        return pa.table({"scan_idx": pa.array([t.column("scan_idx")[0].as_py()] * n, pa.int64()), "alpha": pa.array(list(alphas), pa.float64()), "error": pa.array(errors, pa.float64()), "best": [x == best for x in alphas]})

    return rows.groupBy("scan_idx").applyInArrow(validate, "scan_idx long, alpha double, error double, best boolean")


def _systems(dictionary: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of all scans' systems: what a candidate expects (no intensity) and what is observed (no id). They meet in the scan's task, so no join is needed."""
    none = F.lit(None).cast(dictionary.schema["id"].dataType)
    expected = dictionary.select("scan_idx", "apex_mz", "id", F.coalesce("abundance", F.lit(0.0)).alias("abundance"), F.lit(None).cast("double").alias("intensity"))
    return expected.unionByName(observed.select("scan_idx", "apex_mz", none.alias("id"), F.lit(0.0).alias("abundance"), F.coalesce("intensity", F.lit(0.0)).alias("intensity")))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A scan's observation, its dictionary matrix, and the candidates of the columns."""
    place, row = np.unique(t.column("apex_mz").to_numpy(), return_inverse=True)
    known, seen = (np.flatnonzero(t.column(c).is_valid().to_numpy()) for c in ("id", "intensity"))
    names, column = np.unique(t.column("id").drop_null().to_numpy().astype(np.int64), return_inverse=True)
    y, d = np.zeros(len(place)), np.zeros((len(place), len(names)))
    y[row[seen]] = t.column("intensity").drop_null().to_numpy()
    d[row[known], column] = t.column("abundance").to_numpy()[known]
    return y, d, names


def reconstruct(dictionary: DataFrame, activation: DataFrame, observed: DataFrame) -> DataFrame:
    """``(scan_idx, apex_mz, intensity, fit)`` over all rows that are observed or fitted."""
    fit = dictionary.join(activation.select("scan_idx", "id", "activation"), ["scan_idx", "id"]).groupBy("scan_idx", "apex_mz").agg(F.sum(F.col("abundance") * F.col("activation")).alias("fit"))
    full = observed.join(fit, ["scan_idx", "apex_mz"], "full")
    return full.select("scan_idx", "apex_mz", F.coalesce("intensity", F.lit(0.0)).alias("intensity"), F.coalesce("fit", F.lit(0.0)).alias("fit"))


def fit_metrics(reconstructed: DataFrame, group: str = "scan_idx") -> DataFrame:
    """Root mean squared error, cosine distance and explained intensity of each scan."""
    y, f = F.col("intensity"), F.col("fit")
    sums = reconstructed.groupBy(group).agg(F.avg((y - f) * (y - f)).alias("mse"), F.sum(y * f).alias("yf"), F.sum(y * y).alias("yy"), F.sum(f * f).alias("ff"), F.sum(y).alias("sy"), F.sum(f).alias("sf"))
    cosine = F.try_divide(F.col("yf"), F.sqrt(F.col("yy") * F.col("ff")))
    return sums.select(group, F.sqrt("mse").alias("rmse"), (1 - cosine).alias("cos_dist"), F.try_divide(F.col("sf"), F.col("sy")).alias("intensity_explained"))


def leave_one_out(dictionary: DataFrame, activation: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """Cosine distance of each active candidate to what all others leave of the spectrum on its rows; else 0."""
    rows = dictionary.where("abundance <> 0").join(activation.select("scan_idx", "id", "activation"), ["scan_idx", "id"]).join(reconstructed, ["scan_idx", "apex_mz"])
    d = F.col("abundance")
    left = F.col("intensity") - F.col("fit") + d * F.col("activation")
    sums = rows.groupBy("scan_idx", "id").agg(F.first("activation").alias("activation"), F.sum(left * d).alias("ld"), F.sum(left * left).alias("ll"), F.sum(d * d).alias("dd"))
    distance = 1 - F.try_divide(F.col("ld"), F.sqrt(F.col("ll") * F.col("dd")))
    return sums.select("scan_idx", "id", F.when(F.col("activation") > 0, distance).otherwise(0.0).alias("cos_dist"))


def identified(activation: DataFrame, truth: DataFrame, cut: float = 1.0) -> DataFrame:
    """Each candidate with whether it is active over ``cut`` and whether ``truth(id)`` holds it."""
    known = truth.select("id").distinct().withColumn("_true", F.lit(1))
    joined = activation.join(known, "id", "left")
    return joined.withColumn("y_pred", (F.col("activation") > cut).cast("int")).withColumn("y_true", F.coalesce("_true", F.lit(0))).drop("_true")
