"""Ranking, scaling and trapezoids within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.session import scratch


def _over(group: list[str], *order: Column | str):
    w = Window.partitionBy(*group)
    return w.orderBy(*order) if order else w


def top_with_ties(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Rows whose score is the greatest of their group."""
    return df.join(df.groupBy(*group).agg(F.max(score).alias(score)), [*group, score], "left_semi")


def top_n(df: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group; give an order without ties."""
    return df.withColumn("_n", F.row_number().over(_over(group, *order))).where(F.col("_n") <= n).drop("_n")


def flag_n_smallest(df: DataFrame, group: list[str], n: int, flag: str, value: Column, *ties: Column | str) -> DataFrame:
    """``df`` with ``flag`` true on the ``n`` rows of each group with the least non-null value."""
    rank = F.row_number().over(_over(group, value.asc_nulls_last(), *ties))
    return df.withColumn(flag, value.isNotNull() & (rank <= n))


def keep_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; rows of repeated keys all go."""
    return df.withColumn("_n", F.count("*").over(_over(keys))).where("_n = 1").drop("_n")


def argmin_rows(df: DataFrame, keys: list[str], value: str, *ties: str) -> DataFrame:
    """One row for each key: the one with the least value, null values last."""
    return top_n(df, keys, 1, F.col(value).asc_nulls_last(), *(F.col(t).asc() for t in ties))


def min_max_scale(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """``out``: value scaled to 0..1 within its group; 0 where the group is flat or value null."""
    low, high = F.min(value).over(_over(group)), F.max(value).over(_over(group))
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: rank of the value over the table, ties sharing their mean rank, nulls last.

    Values are counted first; only the distinct ones are ranked, from running counts over
    range partitions' totals.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranked = running_sum(counts, "_n", "_upto", F.col(value).asc_nulls_last())
    ranked = ranked.select(F.col(value).alias("_v"), (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranked, df[value].eqNullSafe(ranked["_v"])).drop("_v")


def running_sum(df: DataFrame, value: str, out: str, *order: Column) -> DataFrame:
    """``out``: sum of ``value`` over the rows up to this one in ``order``, which must have no ties.

    Rows are range-partitioned over as many tasks as a shuffle has, and written with the number
    of their range, so that it stays whatever is computed again; each range sums its own rows
    and adds the totals of the ranges before, one row for each.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(df.sparkSession, "ranges")
    ranged = df.repartitionByRange(slices, *order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    parted = df.sparkSession.read.schema(ranged.schema).parquet(path)
    totals = parted.groupBy("_part").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("_in", within).join(F.broadcast(before), "_part").withColumn(out, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def collapse_others(df: DataFrame, label: str, threshold: float, other: str = "Others") -> DataFrame:
    """Counts by label, greatest first, until their share reaches ``threshold``; the rest as one row.

    The label that crosses the threshold is still named.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    ordered = running_sum(counts, "n", "_upto", F.desc("n"), F.asc_nulls_first(label))
    total = counts.agg(F.sum("n").alias("_total"))
    named = ordered.crossJoin(F.broadcast(total)).withColumn("_label", F.when((F.col("_upto") - F.col("n")) >= threshold * F.col("_total"), other).otherwise(F.col(label)))
    return named.groupBy(F.col("_label").alias(label)).agg(F.sum("n").alias("n"))


def local_maxima(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is above that of the row before and of the row after."""
    w = _over(group, order)
    return df.withColumn("_p", F.lag(value).over(w)).withColumn("_f", F.lead(value).over(w)).where((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_f"))).drop("_p", "_f")


def half_gaps(times: DataFrame, time: str, out: str = "weight", group: list[str] | None = None) -> DataFrame:
    """``out``: half the time to the row before plus half the time to the row after.

    A sum of value times weight is the trapezoid integral, exact for sparse series too, as
    rows of zero need not be there. Without ``group`` the table is a scan header of some
    thousand rows.
    """
    w = _over(group or [], time)
    back, ahead = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    return times.withColumn(out, (F.coalesce(back, F.lit(0.0)) + F.coalesce(ahead, F.lit(0.0))) / 2)


def trapezoid(df: DataFrame, group: list[str], time: str, value: str, out: str = "auc") -> DataFrame:
    """Integral of value over time for each group, by the trapezoid rule."""
    w = _over(group, time)
    step = (F.col(time) - F.lag(time).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return df.withColumn("_step", step).groupBy(*group).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias(out))


def collinear_rank(df: DataFrame, group: list[str], value: str, out: str, *ties: str) -> DataFrame:
    """``out``: (1 - exp(-(n - rank + 1) / n)) / (1 - exp(-1)) by rank of falling value; 1 when alone."""
    rank = F.row_number().over(_over(group, F.desc(value), *ties))
    n = F.count("*").over(_over(group))
    score = (1 - F.exp(-(n - rank + 1) / n)) / (1 - F.exp(F.lit(-1.0)))
    return df.withColumn(out, F.when(n == 1, 1.0).otherwise(score))


def rows_between(df: DataFrame, first: int, last: int, *order: Column) -> DataFrame:
    """Rows number ``first`` to before ``last``, from 0, in ``order``, which must have no ties."""
    ranked = running_sum(df.withColumn("_one", F.lit(1)), "_one", "_rank", *order)
    return ranked.where((F.col("_rank") > first) & (F.col("_rank") <= last)).drop("_one", "_rank")


def path_change(df: DataFrame, group: list[str], order: str, value: str, out: str = "change") -> DataFrame:
    """``out``: by how much the value falls from the row before in its group; null for the first."""
    return df.withColumn(out, F.lag(value).over(_over(group, order)) - F.col(value))


def hash_split(df: DataFrame, key: str, test: float, val: float, seed: int = 0, out: str = "split") -> DataFrame:
    """``out``: train, val or test, the same for all rows of a key, by an arithmetic hash of it."""
    u = F.pmod((F.col(key) + seed) * F.lit(2654435761), F.lit(1000)) / 1000.0
    return df.withColumn(out, F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))
