"""The peak classifier: convolutions over a peak's series, alone or beside further values of the peak."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions.network import Shape
from scanforge.operators.aggregates import class_weights
from scanforge.operators.features import balanced_sample, grouped_split
from scanforge.operators.network import Network, fit_network


def output_bias(df: DataFrame, label: str = "matched") -> float:
    """The log odds of the label, from which the output starts; 0 if one class is missing."""
    y = F.col(label).cast("double")
    n = df.where(F.col(label).isNotNull()).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")).first()
    return math.log(n.pos / n.neg) if n.pos and n.neg else 0.0


def fit_peak_network(
    peaks: DataFrame,
    features: str = "sequence",
    label: str = "matched",
    extra: str | None = None,
    key: str = "id",
    convs: tuple[tuple[int, int], ...] = ((16, 5), (16, 5), (16, 3)),
    dense: tuple[int, ...] = (32, 16),
    balance: str = "none",
    test: float = 0.2,
    val: float = 0.2,
    l2: float = 0.0,
    dropout: float = 0.0,
    fill: float = -1.0,
    seed: int = 0,
    **settings,
) -> tuple[Network, DataFrame]:
    """The network, and ``peaks`` with the ``split`` that it was fitted by; all peaks of a candidate are in one part.

    ``extra`` names an array of further values, joined to the encoded series before the dense layers. ``balance`` is ``none`` (the output starts at the
    classes' log odds), ``weight`` (classes weigh alike) or ``resample`` (rows of the larger class are rejected until both are as many). Lengths are
    read from one row; ``settings`` go to ``fit_network``. Rows without a label or series are of a part but not fitted.
    """
    if balance not in ("none", "weight", "resample"):
        raise ValueError(f"unknown balance {balance}")
    split = grouped_split(peaks, key, test, val, seed)
    usable = split.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    one = usable.select(features, *([extra] if extra else [])).first()
    if one is None:
        raise ValueError("no labelled peak")
    channels = one[0] if isinstance(one[0][0], list) else [one[0]]
    shape = Shape(len(channels[0]), len(channels), tuple(convs), len(one[1]) if extra else 0, tuple(dense), "logistic", l2, dropout, fill)
    train, weight = usable.where("split = 'train'"), None
    if balance == "resample":
        train = balanced_sample(train, label, seed)
    elif balance == "weight":
        w = class_weights(train.withColumn("_y", F.col(label).cast("double")), "_y").first()
        train = train.withColumn("_w", F.when(F.col(label).cast("double") == 1, w["weight_1"]).otherwise(w["weight_0"]))
        weight = "_w"
    held = usable.where("split = 'val'")
    start = Network(shape, shape.start(seed, output_bias(train, label) if balance == "none" else 0.0))
    if weight:
        held = held.withColumn(weight, F.when(F.col(label).cast("double") == 1, w["weight_1"]).otherwise(w["weight_0"]))
    return fit_network(train, held, start, features, label, extra, weight, seed=seed, **settings), split
