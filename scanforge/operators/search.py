"""Search over network shapes and settings by successive halving; each trial is a row.

All trials of a rung are fitted side by side, one task each, on one sample of rows whose size is a
parameter. The better part of them goes on, from the weights they have reached, with more epochs.
"""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions import network as N
from scanforge.operators.network import Network, _inputs, _rows

#: Values that a setting may take.
SPACE = {
    "conv1_filters": list(range(8, 129, 8)), "conv1_kernel": [3, 5, 7, 9], "conv2_filters": list(range(8, 129, 8)), "conv2_kernel": [3, 5, 7, 9], "dense1": list(range(8, 129, 8)),
    "l2": [0.0, 0.1, 0.01, 0.001, 0.0001], "dropout": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5], "rate": [1e-2, 1e-3, 1e-4],
}


def draw_trials(space: dict[str, list], n: int, seed: int = 0) -> list[dict]:
    """``n`` different settings, or all there are, in an order that ``seed`` sets."""
    sizes = [len(v) for v in space.values()]
    total = int(np.prod(sizes, dtype=float))
    rng, taken, out = np.random.default_rng(seed), set(), []
    order = iter(rng.permutation(total).tolist()) if total <= 1 << 20 else iter(lambda: int(rng.integers(total)), None)
    for k in order:
        if len(out) == min(n, total):
            break
        if k not in taken:
            taken.add(k)
            at = np.unravel_index(k, sizes)
            out.append({name: values[int(i)] for (name, values), i in zip(space.items(), at, strict=True)})
    return out


def trial_shape(base: N.Shape, settings: dict) -> N.Shape:
    """``base`` with the layers that the settings name; those not named stay."""
    convs = [(settings[f"conv{i}_filters"], settings[f"conv{i}_kernel"]) for i in range(1, 10) if f"conv{i}_filters" in settings]
    dense = [settings[f"dense{i}"] for i in range(1, 10) if f"dense{i}" in settings]
    return replace(base, convs=tuple(convs) or base.convs, dense=tuple(dense) or base.dense, l2=settings.get("l2", base.l2), dropout=settings.get("dropout", base.dropout))


def sampled(df: DataFrame, kind: str, features: str, extra: str | None, label: str, most_rows: int, seed: int) -> pa.Table:
    """At most ``most_rows`` random labelled rows as ``(x, e, y, w)``; a top-k by a random number, so no task sorts the table."""
    rows = _rows(df.where(F.col(label).isNotNull() & F.col(features).isNotNull()), kind, features, extra, label, None)
    return rows.withColumn("_r", F.rand(seed)).orderBy("_r").limit(most_rows).drop("_r").toArrow()


def run_epochs(shape: N.Shape, flat: np.ndarray, data: tuple, held: tuple, epochs: int, rate: float, batch: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights after ``epochs`` more passes over ``(x, mask, extra, y)``, and their mean loss on ``held``."""
    rng, adam, n = np.random.default_rng(seed), N.Adam(len(flat), rate), len(data[3])
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            _, g = N.loss_and_gradient(shape, flat, *(c[rows] for c in data), np.ones(len(rows)), rng)
            flat = flat + adam.step(g / len(rows) + shape.penalty(flat)[1])
    x, mask, extra, y = held
    out, _ = N.forward(shape, flat, x, mask, extra)
    each = np.logaddexp(0, out) - y * out if shape.loss == "logistic" else (out - y) ** 2 / 2
    return flat, float(each.mean()) if len(y) else float("nan")


def successive_halving(
    train: DataFrame,
    val: DataFrame,
    base: N.Shape,
    features: str = "sequence",
    label: str = "matched",
    extra: str | None = None,
    space: dict[str, list] | None = None,
    trials: int = 27,
    epochs: int = 2,
    eta: int = 3,
    rungs: int = 3,
    most_rows: int = 20_000,
    batch: int = 128,
    bias: float = 0.0,
    kind: str = "array",
    seed: int = 0,
) -> tuple[dict, Network, pd.DataFrame]:
    """The best settings, their network, and all trials: ``trial, rung, epochs, val_loss, settings, kept``.

    Rung r adds ``epochs * eta ** r`` epochs to each trial that is left; the best 1 / ``eta`` of them go on. With
    ``rungs=1`` it is a full search. Trials see at most ``most_rows`` rows of either table: that many are sent to each executor, whatever
    the tables hold. The network returned has seen only these; ``fit_network`` goes on from it over all rows.
    """
    spark = train.sparkSession
    sample = tuple(sampled(df, kind, features, extra, label, most_rows, seed + i) for i, df in enumerate((train, val)))
    sent = spark.sparkContext.broadcast(sample)
    drawn = draw_trials(space or SPACE, trials, seed)
    left = {i: trial_shape(base, s).start(seed + i, bias) for i, s in enumerate(drawn)}
    log, result = [], None

    def work(rung):
        def run(batches):
            for frame in batches:
                for r in frame.itertuples(index=False):
                    settings = json.loads(r.settings)
                    shape = trial_shape(base, settings)
                    arrays = []
                    for t in sent.value:
                        t = t.combine_chunks()
                        b = t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema)
                        arrays.append((*_inputs(shape, kind, b.column("x"), b.column("e")), b.column("y").to_numpy()))
                    flat, loss = run_epochs(shape, np.frombuffer(r.weights), *arrays, epochs * eta**rung, settings.get("rate", 0.001), batch, seed + 1000 * rung + r.trial)
                    yield pd.DataFrame({"trial": [r.trial], "val_loss": [loss], "weights": [flat.tobytes()]})

        return run

    for rung in range(rungs):
        rows = [(i, json.dumps(drawn[i]), w.tobytes()) for i, w in left.items()]
        table = spark.createDataFrame(rows, "trial int, settings string, weights binary").repartition(len(rows), "trial")
        done = table.mapInPandas(work(rung), "trial int, val_loss double, weights binary").collect()
        order = sorted(done, key=lambda r: (not np.isfinite(r.val_loss), r.val_loss, r.trial))
        keep = max(1, len(order) // eta) if rung + 1 < rungs else 1
        for k, r in enumerate(order):
            log.append((r.trial, rung, epochs * eta**rung, r.val_loss, json.dumps(drawn[r.trial]), k < keep))
        left = {r.trial: np.frombuffer(r.weights) for r in order[:keep]}
        result = order[0]
    sent.destroy()
    best = drawn[result.trial]
    return best, Network(trial_shape(base, best), np.frombuffer(result.weights).copy(), kind), pd.DataFrame(log, columns=["trial", "rung", "epochs", "val_loss", "settings", "kept"])
