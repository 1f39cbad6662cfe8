"""Correlation, regression and error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.operators.aggregates import quantiles
from scanforge.operators.windows import average_rank


def regression(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Rows, Pearson correlation, slope and intercept of y on x over rows with both."""
    both = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    return both.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks over rows with both."""
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))


def residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    """``df`` with the absolute distance of y to the line of y on x; the one-row fit is broadcast."""
    fit = regression(df, F.col(x), F.col(y)).select("slope", "intercept")
    out = df.crossJoin(F.broadcast(fit)).withColumn("residual", F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))))
    return out.drop("slope", "intercept")


def extremes(df: DataFrame, value: str, n: int, *ties: str, largest: bool = True) -> DataFrame:
    """The ``n`` rows with the greatest, or least, value."""
    return df.orderBy(F.desc(value) if largest else F.asc_nulls_last(value), *ties).limit(n)


def time_metrics(df: DataFrame, observed: str, predicted: str, coverage: float = 95, mode: str = "abs") -> DataFrame:
    """Width that holds ``coverage`` per cent of the deviations, correlation and mean absolute error.

    ``abs``: twice the percentile of absolute deviations; ``real``: between the two outer percentiles.
    """
    rows = df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull()).select(F.col(observed).cast("double").alias("o"), F.col(predicted).cast("double").alias("p"))
    delta = F.col("o") - F.col("p")
    if mode == "abs":
        width, ends = 2 * F.col("_high"), quantiles(rows, F.abs(delta), {"_high": coverage / 100})
    else:
        width, ends = F.col("_high") - F.col("_low"), quantiles(rows, delta, {"_high": (100 + coverage) / 200, "_low": (100 - coverage) / 200})
    sums = rows.agg(F.corr("o", "p").alias("pearson"), F.avg(F.abs(delta)).alias("mae"))
    return sums.crossJoin(F.broadcast(ends)).select(width.alias("width"), "pearson", "mae")
