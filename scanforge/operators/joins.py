"""Band and nearest joins, indicator joins and overlap labels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Inner join where ``low <= point <= high``, both ends included.

    Each range is repeated for the buckets of ``width`` that it meets and each point has one
    bucket, so the join is an equi-join with a residual filter and yields no row twice. Choose
    ``width`` near the usual length of a range. Null bounds and points join with nothing.
    ``on`` names further columns that must be equal. Ranges lead the join, so that a range's columns
    come in runs, which files hold in little room, however many points a range holds.
    """
    on = on or []
    bucketed = ranges.where(F.col(low) <= F.col(high)).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    )
    left = points.where(F.col(point).isNotNull()).withColumn("_bucket", F.floor(F.col(point) / width))
    joined = bucketed.join(left, [*on, "_bucket"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high)))
    return joined.select(*on, *(c for x in (points, ranges) for c in x.columns if c not in on))


def asof_nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, by: list[str], right_order: str, values: list[str], tolerance: float | None = None, how: str = "left") -> DataFrame:
    """For each left row the right row of the same group with the nearest key.

    At equal distance the lower key is taken. Of right rows with equal keys the last in
    ``right_order`` is taken when it is at or below the left key, else the first. One
    shuffle by ``by``, over as many tasks as a shuffle has, and one sort: both sides are united and
    the neighbours looked up in order of key. ``how="left"`` keeps left rows without a match within ``tolerance``.
    """
    row = F.struct(F.col(right_key).alias("_key"), *(F.col(v) for v in values))
    empty = F.lit(None).cast(right.select(row).schema[0].dataType)
    own = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_key).cast("double").alias("_k"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_order].dataType).alias("_o"), F.struct(*own).alias("_left"), empty.alias("_right"))
    none = F.lit(None).cast(l.schema["_left"].dataType)
    r = right.where(F.col(right_key).isNotNull()).select(*by, F.col(right_key).cast("double").alias("_k"), F.lit(0).alias("_side"), F.col(right_order).alias("_o"), none.alias("_left"), row.alias("_right"))
    order = Window.partitionBy(*by).orderBy("_k", "_side", "_o")
    back = F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # Looking ahead is looking back in the opposite order, which streams instead of buffering.
    opposite = Window.partitionBy(*by).orderBy(F.col("_k").desc(), F.col("_side").desc(), F.col("_o").desc())
    ahead = F.last("_right", ignorenulls=True).over(opposite.rowsBetween(Window.unboundedPreceding, 0))
    # A row takes far more room in the two sorts than in the shuffle, by whose size Spark would merge tasks.
    united = l.unionByName(r).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by) if by else l.unionByName(r)
    both = united.withColumn("_back", back).withColumn("_ahead", ahead).where("_side = 1")
    nearer = F.when(F.col("_ahead").isNull() | (F.col("_k") - F.col("_back._key") <= F.col("_ahead._key") - F.col("_k")), F.col("_back")).otherwise(F.col("_ahead"))
    found = both.withColumn("_hit", F.when(F.col("_k").isNotNull(), nearer))
    if tolerance is not None:
        found = found.withColumn("_hit", F.when(F.abs(F.col("_hit._key") - F.col("_k")) <= tolerance, F.col("_hit")))
    if how == "inner":
        found = found.where(F.col("_hit").isNotNull())
    taken = [F.col("_hit")[v].alias(v) for v in values]
    named = [] if right_key in values else [F.col("_hit._key").alias(right_key)]
    return found.select(*by, *(F.col("_left")[c].alias(c) for c in own), *named, *taken)


def asof_two_pass(left: DataFrame, right: DataFrame, left_key: str, right_key: str, by: list[str], left_id: list[str], right_order: str, tolerance: float, first: Column) -> DataFrame:
    """Nearest within ``tolerance`` for the left rows of ``first``, then the other left rows on the right rows that are left."""
    values = [right_key, right_order]
    strong = asof_nearest(left.where(first), right, left_key, right_key, by, right_order, values, tolerance, "inner")
    free = right.join(strong.select(*by, right_order).distinct(), [*by, right_order], "left_anti")
    weak = asof_nearest(left.where(~F.coalesce(first, F.lit(False))), free, left_key, right_key, by, right_order, values, tolerance, "inner")
    return strong.unionByName(weak)


def nearest_scan(df: DataFrame, scans: DataFrame, time_cols: list[str], time: str = "starttime", scan: str = "scan_idx", by: list[str] = ()) -> DataFrame:
    """``df`` with ``<column>_scan`` for each time column: the scan whose start time is nearest.

    Each scan holds the times from half way after the scan before to half way before the next one,
    that end included, so ties go to the earlier scan. These ranges meet times in buckets about as long as
    scans are apart: equi-joins. Of scans of equal time the first is taken. Null times get null.
    ``by`` names the columns of the run, in both tables: a time is placed among the scans of its own run, and a
    task sorts the start times of one run.
    """
    by = list(by)
    header = scans.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).cast("double").alias("_t")).agg(F.min(scan).alias("_s"))
    around = Window.partitionBy(*by).orderBy("_t")
    cells = header.select(*by, "_s", ((F.lag("_t").over(around) + F.col("_t")) / 2).alias("_lo"), ((F.col("_t") + F.lead("_t").over(around)) / 2).alias("_hi"), "_t")
    span = header.groupBy(*by).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count("*").alias("_n"))
    width = F.greatest((F.col("_last") - F.col("_first")) / F.col("_n"), F.lit(1e-9))

    def bucket(t):
        return F.floor((F.least(F.greatest(t, F.col("_first")), F.col("_last")) - F.col("_first")) / width)

    def with_span(x):
        return x.join(span, by, "left") if by else x.crossJoin(F.broadcast(span))

    spread = with_span(cells).withColumn("_b", F.explode(F.sequence(bucket(F.coalesce("_lo", "_first")), bucket(F.coalesce("_hi", "_last")))))
    spread = spread.select(*by, "_b", "_s", "_lo", "_hi")
    out = with_span(df)
    for c in time_cols:
        cell = spread.select(*(F.col(x).alias(f"{x}_cell") for x in (*by, "_b", "_s", "_lo", "_hi")))
        inside = (F.col("_lo_cell").isNull() | (F.col(c) > F.col("_lo_cell"))) & (F.col("_hi_cell").isNull() | (F.col(c) <= F.col("_hi_cell")))
        out = out.withColumn("_b", bucket(F.col(c))).join(cell, reduce(and_, (F.col(x) == F.col(f"{x}_cell") for x in (*by, "_b"))) & inside, "left")
        out = out.withColumn(f"{c}_scan", F.when(F.col(c).isNotNull(), F.col("_s_cell"))).drop("_b", "_b_cell", "_s_cell", "_lo_cell", "_hi_cell", *(f"{x}_cell" for x in by))
    return out.drop("_first", "_last", "_n")


def right_join_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Right outer join with ``_merge``: ``both`` or ``right_only``. Null keys join with nothing."""
    joined = left.withColumn("_in_left", F.lit(True)).join(right, keys, "right")
    return joined.withColumn("_merge", F.when(F.col("_in_left").isNull(), "right_only").otherwise("both")).drop("_in_left")


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str, how: str = "left", left_suffix: str = "") -> DataFrame:
    """Join on ``keys``; other columns of both sides that share a name get the suffixes."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    l = left.withColumnsRenamed({c: c + left_suffix for c in shared}) if left_suffix else left
    return l.join(right.withColumnsRenamed({c: c + suffix for c in shared}), keys, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both sides have."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no common columns")
    return left.join(right, keys, how)


def pairs_within(df: DataFrame, group: list[str], key: str, values: list[str]) -> DataFrame:
    """Pairs of rows of a group with ``key`` of the first below that of the second, suffixed ``_a`` and ``_b``."""
    a = df.select(*group, F.col(key).alias(f"{key}_a"), *(F.col(v).alias(f"{v}_a") for v in values))
    b = df.select(*group, F.col(key).alias(f"{key}_b"), *(F.col(v).alias(f"{v}_b") for v in values))
    return a.join(b, group).where(F.col(f"{key}_a") < F.col(f"{key}_b"))


def pair_counts(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """How many pairs of rows of a group have each pair of keys, the lower key first: ``<key>_a``, ``<key>_b``, ``n``.

    A group's keys are sorted in one row and paired there, which takes one shuffle of rows and no table of pairs. Null keys pair with nothing.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*group, key).where(reduce(and_, (F.col(c).isNotNull() for c in (*group, key)))).repartition(slices, *group)
    keys = rows.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("_all")).where(F.size("_all") > 1)
    distinct = F.array_distinct("_all")
    many = F.transform(distinct, lambda k: F.struct(k.alias("k"), F.size(F.filter("_all", lambda x: x == k)).cast("long").alias("n")))
    counted = keys.select(*group, F.when(F.size(distinct) < F.size("_all"), many).otherwise(F.transform("_all", lambda k: F.struct(k.alias("k"), F.lit(1).cast("long").alias("n")))).alias("_k"))
    first = counted.select(*group, "_k", F.posexplode("_k").alias("_i", "_a"))
    pairs = first.select(*group, "_a", F.explode(F.slice("_k", F.col("_i") + 2, F.size("_k"))).alias("_b"))
    return pairs.select(*group, F.col("_a.k").alias(f"{key}_a"), F.col("_b.k").alias(f"{key}_b"), (F.col("_a.n") * F.col("_b.n")).alias("n"))


def overlap_label(start_a: str, end_a: str, start_b: str, end_b: str, labels: str = "reference") -> Column:
    """How range b lies to range a: full, partial or no overlap.

    ``labels="reference"`` keeps an established naming in which ranges that are apart are
    called partial and ranges that meet in part are called none; ``"corrected"`` names
    them as they are. Comparisons with null do not hold, so they end at the last label.
    """
    sa, ea, sb, eb = (F.col(c) for c in (start_a, end_a, start_b, end_b))
    full = (sa <= sb) & (ea >= eb)
    apart = (ea < sb) | (sa > eb)
    names = {"reference": ("partial_overlap", "no_overlap"), "corrected": ("no_overlap", "partial_overlap")}[labels]
    out = F.when(F.coalesce(full, F.lit(False)), "full_overlap").when(F.coalesce(apart, F.lit(False)), names[0])
    if labels == "corrected":
        return out.when(sa.isNull() | ea.isNull() | sb.isNull() | eb.isNull(), "no_overlap").otherwise(names[1])
    return out.otherwise(names[1])
