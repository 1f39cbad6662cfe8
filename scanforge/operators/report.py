"""What the figures show, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions.scalar import length_or_zero
from scanforge.operators.aggregates import describe, histogram, top_values, value_counts
from scanforge.operators.metrics import regression, residuals
from scanforge.operators.windows import collapse_others


def pie(df: DataFrame, label: str, threshold: float = 0.95) -> DataFrame:
    return collapse_others(df, label, threshold)


def scatter(df: DataFrame, x: str, y: str, at_least: float | None = None, log: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points, over a threshold on both axes if given, with residuals; and their fit."""
    points = df if at_least is None else df.where((F.col(x) > at_least) & (F.col(y) > at_least))
    if log:
        points = points.withColumn(x, F.log10(F.col(x) + 1)).withColumn(y, F.log10(F.col(y) + 1))
    return residuals(points, x, y), regression(points, F.col(x), F.col(y))


def scan_report(records: DataFrame) -> DataFrame:
    """Scan records with the number of candidates before and after filtering, their ratio, and whether any are left."""
    before, after = length_or_zero(F.col("candidates_by_rt")), length_or_zero(F.col("filtered_candidates"))
    out = records.withColumn("n_by_rt", before).withColumn("n_filtered", after)
    ratio = F.try_divide(F.col("n_filtered").cast("double"), F.col("n_by_rt").cast("double"))
    return out.withColumn("filter_ratio", ratio).withColumn("is_empty", F.col("n_filtered") <= 1)


def distribution(df: DataFrame, value: str, low: float, width: float) -> tuple[DataFrame, DataFrame]:
    return describe(df, value), histogram(df, value, low, width)


def intensity(df: DataFrame, value: str) -> DataFrame:
    """Distribution summary of log10 values over 1, and how many there are."""
    return describe(df.where(F.col(value) > 1).select(F.log10(value).alias("log10")), "log10")


def peak_properties(peaks: DataFrame, value: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Share of each value, and the rows of the ``n`` most frequent ones."""
    return value_counts(peaks, value), top_values(peaks, value, n)


def alpha_track(records: DataFrame) -> DataFrame:
    """log10 of each scan's alpha; 0 is drawn at a tenth of the least positive one."""
    least = records.where("best_alpha > 0").agg(F.min("best_alpha").alias("_least"))
    alpha = F.when(F.col("best_alpha") > 0, F.col("best_alpha")).otherwise(F.col("_least") / 10)
    return records.crossJoin(F.broadcast(least)).withColumn("log10_alpha", F.log10(alpha)).drop("_least")


def activation_window(activation: DataFrame, reference: DataFrame, candidate: int, margin: float = 0.0) -> DataFrame:
    """One candidate's profile within its search range."""
    bounds = reference.where(F.col("id") == candidate).agg(F.min("RT_search_left").alias("lo"), F.max("RT_search_right").alias("hi"))
    own = activation.where(F.col("id") == candidate).crossJoin(F.broadcast(bounds))
    return own.where((F.col("starttime") >= F.col("lo") - margin) & (F.col("starttime") <= F.col("hi") + margin)).drop("lo", "hi")


def pattern_window(scans: DataFrame, scan: int, low: float, high: float) -> DataFrame:
    """A spectrum's points strictly within an m/z range."""
    points = scans.where(F.col("scan_idx") == scan).select(F.inline(F.arrays_zip("mzarray", "intarray")))
    return points.where((F.col("mzarray") > low) & (F.col("mzarray") < high))


def log_columns(df: DataFrame, columns: list[str], base: str = "log10", add: float = 0.0) -> DataFrame:
    """``df`` with ``<base>_<column>`` of each column plus ``add``; null where that is not above 0. base: log10, log2 or log."""
    f = {"log10": F.log10, "log2": F.log2, "log": F.log}[base]
    return df.withColumns({f"{base}_{c}": F.when(F.col(c) + add > 0, f(F.col(c) + add)) for c in columns})


def measures_side_by_side(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """``(key, <name>...)``: one measure from several analyses, keys of any of them."""
    named = [df.groupBy(key).agg(F.sum(value).alias(name)) for name, df in tables.items()]
    out = named[0]
    for more in named[1:]:
        out = out.join(more, key, "full")
    return out


def true_and_predicted(df: DataFrame, truth: str, predicted: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Points with their error and whether it is within ``tolerance``; and how many are, with the line of one on the other."""
    points = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).withColumn("error", F.col(predicted) - F.col(truth))
    points = points.withColumn("within", F.abs("error") <= tolerance)
    summary = points.agg(F.count("*").alias("n"), F.avg(F.col("within").cast("double")).alias("share_within"), F.corr(truth, predicted).alias("pearson"), F.avg(F.abs("error")).alias("mae"))
    return points, summary


def score_distribution(df: DataFrame, score: str, truth: str, bins: int = 20) -> DataFrame:
    """Rows by class and bin of a score from 0 to 1, the last bin with its end, and their share of the class."""
    found = df.where(F.col(score).isNotNull()).groupBy(F.col(truth).alias("truth"), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    total = found.groupBy("truth").agg(F.sum("n").alias("_total"))
    joined = found.alias("f").join(total.alias("t"), F.col("f.truth").eqNullSafe(F.col("t.truth")))
    return joined.select("f.truth", "bin", "n", (F.col("n") / F.col("_total")).alias("share"))


def activation_and_score(activation: DataFrame, peaks: DataFrame, candidate: int, score: str = "pred_score") -> DataFrame:
    """One candidate's profile with the score of the peak that each scan lies in, the best where peaks meet."""
    own = activation.where(F.col("id") == candidate)
    found = peaks.where(F.col("id") == candidate).select(F.col("id").alias("_id"), "start_scan", "end_scan", F.col(score).alias("_score"))
    inside = (F.col("id") == F.col("_id")) & (F.col("scan_idx") >= F.col("start_scan")) & (F.col("scan_idx") <= F.col("end_scan"))
    return own.join(found, inside, "left").groupBy("id", "scan_idx", "starttime", "activation").agg(F.max("_score").alias(score))


def isotope_comparison(dictionary: DataFrame, observed: DataFrame, activation: DataFrame, scan: int) -> DataFrame:
    """One spectrum's peaks with what each active candidate explains of them."""
    own = dictionary.where(F.col("scan_idx") == scan).join(activation.where("activation > 0").select("scan_idx", "id", "activation"), ["scan_idx", "id"])
    parts = own.select("scan_idx", "apex_mz", "id", (F.col("abundance") * F.col("activation")).alias("explained"))
    return observed.where(F.col("scan_idx") == scan).join(parts, ["scan_idx", "apex_mz"], "left").select("scan_idx", "apex_mz", "intensity", "id", "explained")
