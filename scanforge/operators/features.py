"""Fixed-length features of elution peaks, grouped splits and peak scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanforge.functions.scalar import key_digest
from scanforge.operators.aggregates import class_weights
from scanforge.operators.joins import band_join
from scanforge.operators.reshape import clip_range, mask_range, min_max, pad_after, pad_both, z_score
from scanforge.operators.windows import top_n, top_with_ties


def dense_series(activation: DataFrame, scans: DataFrame, reference: DataFrame, width: float = 2.0) -> DataFrame:
    """``(id, values)``: each candidate's activations over the scans of its search range, zeros included.

    Also ``first_scan``, the first scan of the range, against which peaks are placed.
    ``width``: the usual length of a search range.
    """
    grid = band_join(scans.select("scan_idx", "starttime"), reference.select("id", "RT_search_left", "RT_search_right"), "starttime", "RT_search_left", "RT_search_right", width)
    full = grid.join(activation.select("id", "scan_idx", "activation"), ["id", "scan_idx"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("scan_idx", F.coalesce("activation", F.lit(0.0)).alias("v"))))
    return full.groupBy("id").agg(F.min("scan_idx").alias("first_scan"), F.transform(ordered, lambda x: x["v"]).alias("values"))


def transform_activation(series: DataFrame, log_intensity: bool = True, standardize: str | None = None) -> DataFrame:
    """``values`` as ln(x + 1), then ``std`` or ``minmax`` over the whole row."""
    values = F.transform("values", lambda x: F.log1p(x)) if log_intensity else F.col("values")
    if standardize not in (None, "std", "minmax"):
        raise ValueError(f"unknown standardize {standardize}")
    scaled = {None: lambda v: v, "std": z_score, "minmax": min_max}[standardize]
    return series.withColumn("values", values).withColumn("values", scaled(F.col("values")))


def peak_sequences(peaks: DataFrame, series: DataFrame, length: int, method: str = "mask", margin: int = 3, pad: str = "post", fill: float = -1.0) -> DataFrame:
    """Peaks with ``sequence``: their series masked outside, or clipped to, the peak and ``margin`` scans, padded."""
    joined = peaks.join(series, "id")
    low, high = F.col("start_scan") - F.col("first_scan") - margin, F.col("end_scan") - F.col("first_scan") + margin
    cut = {"mask": mask_range, "clip": clip_range}[method](F.col("values"), low, high)
    padded = {"post": pad_after, "two_side": pad_both}[pad](cut, length, fill)
    return joined.withColumn("sequence", padded).drop("values", "first_scan")


def scan_labels(series: DataFrame, measured: DataFrame) -> DataFrame:
    """``series`` with ``labels``: 1 for scans from ``start_scan`` to before ``finish_scan``."""
    joined = series.join(measured.select("id", "start_scan", "finish_scan"), "id")
    inside = F.transform("values", lambda v, i: ((i + F.col("first_scan") >= F.col("start_scan")) & (i + F.col("first_scan") < F.col("finish_scan"))).cast("int"))
    return joined.withColumn("labels", F.coalesce(inside, F.transform("values", lambda v: F.lit(0))))


def grouped_split(df: DataFrame, key: str, test: float = 0.2, val: float = 0.2, seed: int = 0) -> DataFrame:
    """``split`` by key: the keys are put in a hashed order; train, val and test get whole keys of exact numbers.

    Ranks come from running counts over range partitions, so no task sees all keys.
    """
    from scanforge.operators.windows import running_sum

    keys = df.select(key).distinct().withColumn("_h", key_digest(F.col(key), seed)).withColumn("_one", F.lit(1))
    ranked = running_sum(keys, "_one", "_rank", F.col("_h"), F.col(key))
    total = keys.agg(F.count("*").alias("_n"))
    n = F.col("_n")
    train, validate = F.floor(n * (1 - test - val)), F.floor(n * val)
    part = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + validate, "val").when(F.col("_rank") > n - F.floor(n * test), "test")
    return df.join(ranked.crossJoin(F.broadcast(total)).select(key, part.alias("split")), key)


def balanced_sample(df: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """Rows of larger classes sampled down, in expectation, to the smallest one; rows without a class go."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n").alias("_least"))
    joined = df.join(counts, label).crossJoin(F.broadcast(least))
    return joined.where(F.rand(seed) * F.col("_n") < F.col("_least")).select(df.columns)


def stacked_features(sequences: DataFrame, *columns: str, out: str = "features", length: str = "sequence") -> DataFrame:
    """``out``: the array ``length`` as one channel, and each further column repeated as often, as another."""
    repeated = (F.transform(length, (lambda c: lambda x: F.col(c).cast("double"))(c)) for c in columns)
    return sequences.withColumn(out, F.array(F.col(length), *repeated))


def fit_scorer(df: DataFrame, features: str = "sequence", label: str = "matched", folds: int = 3, grid: list[float] = (0.0, 0.01, 0.1)):
    """A class-weighted logistic model on array features, its regularisation chosen by cross-validation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = df.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")).withColumn("_v", array_to_vector(features))
    w = class_weights(data, "label").first()
    data = data.withColumn("_w", F.when(F.col("label") == 1, w["weight_1"]).otherwise(w["weight_0"]))
    lr = LogisticRegression(featuresCol="_v", labelCol="label", weightCol="_w", maxIter=50)
    params = ParamGridBuilder().addGrid(lr.regParam, list(grid)).build()
    return CrossValidator(estimator=Pipeline(stages=[lr]), estimatorParamMaps=params, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=0).fit(data).bestModel


def score_peaks(model, df: DataFrame, features: str = "sequence", out: str = "pred_score") -> DataFrame:
    """``df`` with the probability that a peak is the right one."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.withColumn("_v", array_to_vector(features)))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def top_scored(df: DataFrame, n: int, id_col: str = "id", score: str = "pred_score") -> DataFrame:
    """The best peak of each candidate, ties kept; or the best ``n``, ties by apex."""
    return top_with_ties(df, [id_col], score) if n == 1 else top_n(df, [id_col], n, F.desc(score), F.col("apex_scan"))


def id_accuracy(df: DataFrame, n: int, truth: str = "y_true", score: str = "y_pred_prob", id_col: str = "id") -> DataFrame:
    """Share of candidates, of those with a right peak, that have it among their ``n`` best."""
    possible = df.withColumn("_t", F.max(F.col(truth).cast("int")).over(Window.partitionBy(id_col))).where("_t = 1").drop("_t")
    best = top_with_ties(possible, [id_col], score) if n == 1 else top_n(possible, [id_col], n, F.desc(score), F.col(truth).desc())
    hits = best.groupBy(id_col).agg(F.max(F.col(truth).cast("int")).alias("hit"))
    return hits.agg(F.count("*").alias("n_ids"), F.avg("hit").alias("accuracy"))
