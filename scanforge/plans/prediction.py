"""Retention-time prediction: features, model, and matching of predictions to measurements."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions.kernels import RESIDUES
from scanforge.functions.network import RESIDUE_CODES, Shape
from scanforge.functions.scalar import bare_sequence
from scanforge.operators.aggregates import first_by
from scanforge.operators.calibration import apply_calibration, fit_calibration
from scanforge.operators.network import Network, fit_network, score_network
from scanforge.operators.windows import argmin_rows


def residue_counts(df: DataFrame, sequence_col: str) -> DataFrame:
    """``df`` with one count for each residue and the length, as ``_n_...``."""
    bare = bare_sequence(F.col(sequence_col))
    return df.withColumns({f"_n_{r}": F.regexp_count(bare, F.lit(r)).cast("double") for r in RESIDUES} | {"_n_all": F.length(bare).cast("double")})


def fit_times(train: DataFrame, sequence_col: str, time_col: str, regularisation: float = 0.01):
    """A linear model of the retention time on residue counts; any model with a prediction column can stand for it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = residue_counts(train.where(F.col(sequence_col).isNotNull() & F.col(time_col).isNotNull()), sequence_col)
    columns = [c for c in rows.columns if c.startswith("_n_")]
    assemble = VectorAssembler(inputCols=columns, outputCol="_x")
    return Pipeline(stages=[assemble, LinearRegression(featuresCol="_x", labelCol=time_col, predictionCol="predicted_RT", regParam=regularisation)]).fit(rows)


def predict_times(model, df: DataFrame, sequence_col: str) -> DataFrame:
    out = model.transform(residue_counts(df, sequence_col))
    return out.drop("_x", *(c for c in out.columns if c.startswith("_n_")))


@dataclass
class TimeModel:
    """A network over residues with the scale of its times, and a calibration curve if one was fitted."""

    network: Network
    center: float
    scale: float
    curve: DataFrame | None = None

    def predict(self, df: DataFrame, sequence_col: str, out: str = "predicted_RT") -> DataFrame:
        """``df`` with ``out``; null where there is no sequence."""
        scored = score_network(self.network, df, sequence_col, out=out).withColumn(out, F.col(out) * self.scale + self.center)
        return scored if self.curve is None else apply_calibration(scored, self.curve, out, out=out)


def _scaled(df: DataFrame, time_col: str, center: float, scale: float) -> DataFrame:
    return df.withColumn("_time", (F.col(time_col) - center) / scale)


def fit_time_network(train: DataFrame, val: DataFrame, sequence_col: str, time_col: str, length: int = 60, convs=((32, 5), (32, 5)), dense=(32,), seed: int = 0, **settings) -> TimeModel:
    """Convolutions over residues and modifications, fitted to times scaled by their mean and deviation. ``settings`` as in ``fit_network``."""
    shape = Shape(length, len(RESIDUE_CODES), tuple(convs), 0, tuple(dense), "squared")
    m = train.agg(F.avg(time_col).alias("mean"), F.stddev(time_col).alias("sd")).first()
    center, scale = m["mean"] or 0.0, m["sd"] or 1.0
    net = fit_network(_scaled(train, time_col, center, scale), _scaled(val, time_col, center, scale), Network(shape, shape.start(seed), "residues"), sequence_col, "_time", seed=seed, **settings)
    return TimeModel(net, center, scale)


def transfer_times(model: TimeModel, train: DataFrame, val: DataFrame, sequence_col: str, time_col: str, frozen: tuple[str, ...] = ("conv",), **settings) -> TimeModel:
    """``model`` fitted further to other times from where it is; layers in ``frozen`` keep their weights."""
    scaled = (_scaled(df, time_col, model.center, model.scale) for df in (train, val))
    return replace(model, network=fit_network(*scaled, model.network, sequence_col, "_time", frozen=frozen, **settings), curve=None)


def calibrate_times(model: TimeModel, measured: DataFrame, sequence_col: str, time_col: str, method: str = "spline", **settings) -> TimeModel:
    """``model`` with a curve from its own predictions to measured times; its weights stay."""
    plain = replace(model, curve=None)
    return replace(model, curve=fit_calibration(plain.predict(measured, sequence_col), "predicted_RT", time_col, method=method, **settings))


def update_times(model: TimeModel, train: DataFrame, val: DataFrame, sequence_col: str, time_col: str, how: str = "calib", **settings) -> TimeModel:
    """``calib`` fits a curve to all measured rows; ``transfer`` fits the free layers further and then a curve, as times of another gradient are not straight."""
    if how == "calib":
        return calibrate_times(model, train.unionByName(val), sequence_col, time_col, **settings)
    if how == "transfer":
        return calibrate_times(transfer_times(model, train, val, sequence_col, time_col, **settings), train.unionByName(val), sequence_col, time_col)
    raise ValueError(f"unknown update {how}")


def match_predictions(measured: DataFrame, predicted: DataFrame, keys: list[str], time_col: str, group: list[str], keep: str | float | None, ties: list[str], sums: tuple[str, ...] = ("Intensity",)) -> DataFrame:
    """Measured rows with their prediction and its distance.

    keep: None, all; ``closest``, the row of each group nearest to its prediction; a number,
    rows within it, one for each group with the columns ``sums`` added up and else the first row.
    """
    joined = measured.join(predicted, keys, "left").withColumn("RT_diff", F.abs(F.col(time_col) - F.col("predicted_RT")))
    if keep is None:
        return joined
    if keep == "closest":
        return argmin_rows(joined.where("RT_diff is not null"), group, "RT_diff", *ties)
    if not isinstance(keep, (int, float)) or isinstance(keep, bool):
        raise ValueError("keep must be None, 'closest' or a number")
    near = joined.where(F.col("RT_diff") <= keep)
    others = [c for c in joined.columns if c not in group and c not in sums]
    total = [F.sum(c).alias(c) for c in sums if c in joined.columns]
    return near.groupBy(*group).agg(*(first_by(c, *ties).alias(c) for c in others if c not in ties), *(F.min(t).alias(t) for t in ties), *total)


def coalesce_times(df: DataFrame, *columns: str, out: str = "Retention time new") -> DataFrame:
    """``out``: the first of the columns that is not null."""
    return df.withColumn(out, F.coalesce(*(F.col(c) for c in columns)))
