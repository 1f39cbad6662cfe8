"""Networks fitted to tables: gradients are summed over partitions, steps are taken on the driver.

Only parameters and their gradients move: a few thousand numbers a task, added up in two
levels before they reach the driver. Rows stay where they are, written once and split into mini-batches.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.functions import network as N
from scanforge.session import scratch

#: Gradients that one task adds up before the driver does.
FAN_IN = 32


@dataclass
class Network:
    """A shape with its parameters. ``input`` says what sequences are: ``array`` of numbers, or ``residues`` of a peptide."""

    shape: N.Shape
    weights: np.ndarray
    input: str = "array"
    history: list[dict] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        row = (json.dumps({**asdict(self.shape), "input": self.input}), self.weights.tolist())
        spark.createDataFrame([row], "shape string, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        row = spark.read.parquet(path).first()
        shape = json.loads(row.shape)
        kind = shape.pop("input")
        shape |= {"convs": tuple(map(tuple, shape["convs"])), "dense": tuple(shape["dense"])}
        return cls(N.Shape(**shape), np.array(row.weights), kind)


def _rows(df: DataFrame, kind: str, features: str, extra: str | None, label: str | None, weight: str | None) -> DataFrame:
    x = F.col(features) if kind == "residues" or "array<array" not in df.schema[features].dataType.simpleString() else F.flatten(features)
    columns = [(x.cast("string") if kind == "residues" else x.cast("array<double>")).alias("x"), (F.col(extra).cast("array<double>") if extra else F.array().cast("array<double>")).alias("e")]
    if label:
        columns += [F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]
    return df.select(*columns)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of one length as a matrix; anything else is an error."""
    if (column.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError(f"arrays of {width} values are needed")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _inputs(shape: N.Shape, kind: str, x: pa.Array, e: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    extra = np.nan_to_num(_numbers(e, shape.extra))
    if not shape.convs:
        return np.zeros((len(e), 1, 1)), np.zeros((len(e), 1), bool), extra
    if kind == "residues":
        return *N.encode_residues(shape, x.to_pylist()), extra
    return *N.encode_arrays(shape, _numbers(x, shape.channels * shape.length)), extra


def gradient_sums(rows: DataFrame, network: Network, seed: int | None = None, block: int = 512) -> tuple[float, float, np.ndarray]:
    """Sums over ``rows(x, e, y, w)`` of weights, loss and gradient. ``seed`` turns dropout on; ``block`` bounds memory."""
    shape, kind, flat = network.shape, network.input, network.weights
    parts = rows.rdd.getNumPartitions()
    buckets = math.ceil(parts / FAN_IN)

    def partial(batches):
        rng = None if seed is None else np.random.default_rng([seed, TaskContext.get().partitionId()])
        total, loss, g = 0.0, 0.0, np.zeros(len(flat))
        for b in batches:
            for at in range(0, b.num_rows, block):
                some = b.slice(at, block)
                y, w = some.column("y").to_numpy(), some.column("w").to_numpy()
                own, slope = N.loss_and_gradient(shape, flat, *_inputs(shape, kind, some.column("x"), some.column("e")), y, w, rng)
                total, loss, g = total + float(w.sum()), loss + own, g + slope
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([TaskContext.get().partitionId() % buckets], pa.int32()), "n": [total], "loss": [loss], "g": pa.array([g.tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        g = sum(np.frombuffer(x) for x in t.column("g").to_pylist())
        return pa.table({"n": [sum(t.column("n").to_pylist())], "loss": [sum(t.column("loss").to_pylist())], "g": pa.array([g.tobytes()], pa.binary())})

    sums = rows.mapInArrow(partial, "bucket int, n double, loss double, g binary")
    if buckets > 1:
        sums = sums.groupBy("bucket").applyInArrow(add, "n double, loss double, g binary")
    got = sums.select("n", "loss", "g").collect()
    return sum(r.n for r in got), sum(r.loss for r in got), sum((np.frombuffer(r.g) for r in got), np.zeros(len(flat)))


def mean_loss(rows: DataFrame, network: Network) -> float:
    """Weighted mean loss of ``rows(x, e, y, w)``."""
    shape, kind, flat = network.shape, network.input, network.weights

    def partial(batches):
        for b in batches:
            out, _ = N.forward(shape, flat, *_inputs(shape, kind, b.column("x"), b.column("e")))
            y, w = b.column("y").to_numpy(), b.column("w").to_numpy()
            each = np.logaddexp(0, out) - y * out if shape.loss == "logistic" else (out - y) ** 2 / 2
            yield pa.RecordBatch.from_pydict({"n": [float(w.sum())], "loss": [float((w * each).sum())]})

    r = rows.mapInArrow(partial, "n double, loss double").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).first()
    return r.loss / r.n if r.n else math.nan


class Plateau:
    """When to lower the rate and when to stop, from the validation losses of the epochs."""

    def __init__(self, rate: float, patience: int, stop: int, factor: float, least: float):
        self.rate, self.patience, self.stop, self.factor, self.least = rate, patience, stop, factor, least
        self.best, self.since, self.flat = math.inf, 0, 0

    def see(self, loss: float) -> tuple[bool, bool]:
        """Whether the loss is the best so far, and whether to stop."""
        if loss < self.best:
            self.best, self.since, self.flat = loss, 0, 0
            return True, False
        self.since, self.flat = self.since + 1, self.flat + 1
        if self.flat >= self.patience:
            self.rate, self.flat = max(self.rate * self.factor, self.least), 0
        return False, self.since >= self.stop


def fit_network(
    train: DataFrame,
    val: DataFrame,
    network: Network,
    features: str = "sequence",
    label: str = "matched",
    extra: str | None = None,
    weight: str | None = None,
    frozen: tuple[str, ...] = (),
    epochs: int = 50,
    batches: int = 4,
    rate: float = 0.01,
    plateau: int = 3,
    patience: int = 5,
    factor: float = 0.1,
    least_rate: float = 1e-4,
    seed: int = 0,
) -> Network:
    """The network of the epoch with the least validation loss.

    It goes on from the weights of ``network``; parameters of ``frozen`` layers stay as they are. Each
    epoch passes ``batches`` mini-batches of random rows. The rate falls by ``factor`` after ``plateau`` epochs without a better validation loss,
    and fitting ends after ``patience``. Rows without a label or sequence are left out; missing places of a sequence are masked.
    """
    spark = train.sparkSession
    given = lambda df: _rows(df.where(F.col(label).isNotNull() & F.col(features).isNotNull()), network.input, features, extra, label, weight)
    path = scratch(spark, "network")
    given(train).withColumn("batch", F.floor(F.rand(seed) * batches).cast("int")).write.partitionBy("batch").parquet(f"{path}/train")
    given(val).write.parquet(f"{path}/val")
    schema = "x array<double>, e array<double>, y double, w double"
    if network.input == "residues":
        schema = schema.replace("x array<double>", "x string")
    rows, held = spark.read.schema(f"{schema}, batch int").parquet(f"{path}/train"), spark.read.schema(schema).parquet(f"{path}/val")
    free = network.shape.free(tuple(frozen))
    now = replace(network, weights=network.weights.copy(), history=[])
    best, adam, course = now.weights.copy(), N.Adam(len(free), rate), Plateau(rate, plateau, patience, factor, least_rate)
    for epoch in range(epochs):
        for b in range(batches):
            # A batch is a folder, so only its own files are read.
            n, _, g = gradient_sums(rows.where(F.col("batch") == b).select("x", "e", "y", "w"), now, seed=seed + epoch * batches + b)
            if n:
                now.weights = now.weights + free * adam.step(free * (g / n + now.shape.penalty(now.weights)[1]))
        loss = mean_loss(held, now)
        better, stop = course.see(loss)
        now.history.append({"epoch": epoch, "val_loss": loss, "rate": adam.rate})
        adam.rate = course.rate
        if better:
            best = now.weights.copy()
        if stop:
            break
    return replace(now, weights=best)


def score_network(network: Network, df: DataFrame, features: str = "sequence", extra: str | None = None, out: str = "pred_score") -> DataFrame:
    """``df`` with the network's output: a probability, or a value under squared loss; null where there is no sequence."""
    shape, kind, flat = network.shape, network.input, network.weights

    @F.pandas_udf("double")
    def score(x: pd.Series, e: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        values = np.full(len(x), np.nan)
        if known.any():
            arrays = pa.array(x[known].tolist(), pa.string() if kind == "residues" else pa.list_(pa.float64()))
            values[known] = N.predict(shape, flat, *_inputs(shape, kind, arrays, pa.array(e[known].tolist(), pa.list_(pa.float64()))))
        return pd.Series(values).astype(object).where(known, None)

    x = F.col(features)
    if kind != "residues":
        x = (F.flatten(features) if "array<array" in df.schema[features].dataType.simpleString() else x).cast("array<double>")
    return df.withColumn(out, score(x, F.col(extra).cast("array<double>") if extra else F.array().cast("array<double>")))
