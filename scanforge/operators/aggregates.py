"""Grouped summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.operators.windows import running_sum


def first_by(value: str, *order: str) -> Column:
    """The first non-null value in ``order``."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))


def summarise(df: DataFrame, keys: list[str], first: list[str], order: list[str], median: list[str] = (), total: list[str] = (), least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """One row for each key, null keys left out: first non-null, exact median, sum, min and max columns."""
    found = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    aggs = [
        *(first_by(c, *order).alias(c) for c in first), *(F.median(c).alias(f"{c}_median") for c in median), *(F.sum(c).alias(f"{c}_sum") for c in total),
        *(F.min(c).alias(f"{c}_min") for c in least), *(F.max(c).alias(f"{c}_max") for c in most),
    ]
    return found.groupBy(*keys).agg(*aggs)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("_t").cast("double"))).drop("_t")


def target_decoy(df: DataFrame, flag: Column, key: str, value: str) -> DataFrame:
    """Rows and mean value where the flag is set (1) and where it is null (0)."""
    return df.groupBy(F.when(flag.isNull(), 0).otherwise(1).alias("decoy")).agg(F.count(key).alias("n"), F.avg(value).alias("mean"))


def first_last_above(df: DataFrame, group: list[str], index: str, value: str, threshold: float) -> DataFrame:
    """Least and greatest index with a value above the threshold, and how many places they span."""
    found = df.where(F.col(value) > threshold).groupBy(*group).agg(F.min(index).alias("first"), F.max(index).alias("last"))
    return found.withColumn("span", F.col("last") - F.col("first") + 1)


def quantiles(df: DataFrame, value: Column, shares: dict[str, float]) -> DataFrame:
    """One row with the exact quantiles of a column, with linear interpolation, by their names; nulls are left out.

    Values are counted, and running counts over range partitions give their ranks, so no task holds all values.
    """
    counts = df.select(value.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
    ranked = running_sum(counts, "_n", "_upto", F.col("_v").asc())
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.sum("_n").alias("_all"))))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v")))

    places = {name: F.lit(float(q)) * (F.col("_all") - 1) for name, q in shares.items()}
    found = ranked.agg(*(x for name, p in places.items() for x in (F.max(p).alias(f"_p_{name}"), at(F.floor(p)).alias(f"_a_{name}"), at(F.ceil(p)).alias(f"_z_{name}"))))

    def between(name: str) -> Column:
        p, a, z = (F.col(f"_{x}_{name}") for x in "paz")
        return F.when(F.floor(p) == F.ceil(p), a.cast("double")).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * z)

    return found.select(*(between(name).alias(name) for name in shares))


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max."""
    v = F.col(value)
    moments = df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    quartiles = quantiles(df, v, {f"{value}_q{round(100 * q)}": q for q in (0.25, 0.5, 0.75)})
    return moments.crossJoin(F.broadcast(quartiles)).select("count", "mean", "std", "min", *quartiles.columns, "max")


def histogram(df: DataFrame, value: str, low: float, width: float) -> DataFrame:
    """Rows in each bin of ``width`` from ``low``."""
    return df.where(F.col(value).isNotNull()).groupBy(F.floor((F.col(value) - low) / width).alias("bin")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows that hold one of the ``n`` most frequent values, ties by value."""
    top = df.groupBy(value).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), value).limit(n)
    return df.join(F.broadcast(top.select(value)), value, "left_semi")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Positives, negatives, log-odds bias, class weights and priors of a 0/1 label, nulls left out."""
    pos, neg = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    c = df.where(F.col(label).isNotNull()).agg(pos.cast("bigint").alias("pos"), neg.cast("bigint").alias("neg"))
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")
    return c.select("pos", "neg", F.log(F.try_divide(p, n)).alias("bias"), F.try_divide(p + n, 2 * n).alias("weight_0"), F.try_divide(p + n, 2 * p).alias("weight_1"), F.try_divide(p, p + n).alias("prior_1"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of the four outcomes of 0/1 columns with accuracy, precision, recall and F1."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )
    d = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    precision, recall = F.try_divide(d["tp"], d["tp"] + d["fp"]), F.try_divide(d["tp"], d["tp"] + d["fn"])
    return c.select(
        "*", F.try_divide(d["tp"] + d["tn"], d["tp"] + d["fp"] + d["fn"] + d["tn"]).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * d["tp"], 2 * d["tp"] + d["fp"] + d["fn"]).alias("f1"),
    )


def collisions(df: DataFrame, value: str, digits: int) -> DataFrame:
    """Values, rounded half to even, that more than one row shares."""
    return df.groupBy(F.bround(value, digits).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def set_union(df: DataFrame, group: list[str], lists: str, out: str) -> DataFrame:
    """Sorted distinct elements of a group's arrays."""
    return df.groupBy(*group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))).alias(out))


def residual_rows(df: DataFrame, group: list[str], place: str, share: str) -> DataFrame:
    """``df``'s groups, places and shares, with a row at place 0 for what is missing to 1."""
    rest = df.groupBy(*group).agg((1 - F.sum(share)).alias(share)).withColumn(place, F.lit(0).cast(df.schema[place].dataType))
    return df.select(*group, place, share).unionByName(rest)


def log_odds(positive: int, negative: int) -> float:
    """The output bias that starts a classifier at the classes' frequencies."""
    return math.log(positive / negative)
