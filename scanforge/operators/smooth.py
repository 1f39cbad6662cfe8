"""Smoothing and integration of activation series, sparse in time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions import kernels
from scanforge.operators.windows import half_gaps


#: Beyond so many bandwidths a Gaussian weight is 0 in double precision.
REACH = 39.0


def gaussian_smooth(activation: DataFrame, bandwidth: float = 0.02, group: str = "id", time: str = "starttime", value: str = "activation", piece: float = 400.0, whole: int = 5000) -> DataFrame:
    """Series smoothed at their non-zero scans by a normalised Gaussian kernel.

    Each weighted term is rounded half to even before it is summed. Series that do not sum to
    more than 0 over more than 2 non-zero scans stay as they are. A series of more than ``whole`` points is cut into
    pieces of ``piece`` bandwidths, each with what lies within reach of it, so that no task
    holds a whole long series; results are those of the whole.
    """
    g, s, d = (activation.schema[c].dataType.simpleString() for c in (group, "scan_idx", time))
    points = activation.where(F.col(value) != 0).select(F.col(group).alias("g"), F.col(time).alias("t"), F.col("scan_idx").alias("s"), F.col(value).cast("double").alias("v"))
    sums = points.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    smoothed = points.join(sums, "g").withColumn("still", (F.col("n") <= 2) | ~(F.col("total") > 0))
    number = lambda t: F.when(F.col("n") <= whole, F.lit(0)).otherwise(F.floor(t / F.lit(piece * bandwidth)))
    meets = F.sequence(number(F.col("t") - REACH * bandwidth), number(F.col("t") + REACH * bandwidth))
    cut = smoothed.where("not still").withColumn("own", number(F.col("t").cast("double"))).withColumn("piece", F.explode(meets))
    own = F.array_sort(F.collect_list(F.struct("t", "s", "v", (F.col("own") == F.col("piece")).alias("mine"))))
    series = cut.groupBy("g", "piece").agg(own.alias("a")).where(F.exists("a", lambda x: x["mine"]))
    series = series.select("g", *(F.transform("a", (lambda c: lambda x: x[c])(c)).alias(c) for c in ("t", "s", "v", "mine")))

    def smooth(batches):
        for b in batches:
            for k in range(b.num_rows):
                t, places, v, mine = (b.column(c)[k].values for c in ("t", "s", "v", "mine"))
                at = np.flatnonzero(mine.to_numpy(zero_copy_only=False))
                new = kernels.gaussian(np.asarray(t, float), np.asarray(v, float), bandwidth, at)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("g").take(pa.array([k] * len(at))), places.take(take), t.take(take), pa.array(new, pa.float64())], [group, "scan_idx", time, value])

    same = smoothed.where("still").select(F.col("g").alias(group), F.col("s").alias("scan_idx"), F.col("t").alias(time), F.col("v").alias(value))
    return series.mapInArrow(smooth, f"`{group}` {g}, scan_idx {s}, `{time}` {d}, `{value}` double").unionByName(same)


def local_minima_smooth(activation: DataFrame, scans: DataFrame, minima_width: float = 3, prominence: float = 10000, by: list[str] = ()) -> DataFrame:
    """Series with narrow deep minima repaired; see ``kernels.repair_minima``.

    A minimum may be a missing scan, so each series is laid out over the scans of its run.
    """

    def repair(t: pa.Table, grid: np.ndarray, times: np.ndarray) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for i, place, act in dense_rows(t, grid):
            dense = np.zeros(len(grid))
            dense[place] = act
            fixed = kernels.repair_minima(dense, minima_width, prominence) if (dense != 0).sum() > 2 and dense.sum() > 0 else dense
            at = np.flatnonzero(fixed)
            parts.append((np.full(len(at), i), grid[at], times[at], fixed[at]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["id", "scan_idx", "starttime", "activation"])

    return on_grids(series_arrays(activation, by), scans, repair, "id long, scan_idx long, starttime double, activation double", by)


def series_arrays(activation: DataFrame, by: list[str] = ()) -> DataFrame:
    """Non-zero activations of each candidate as arrays of scans and values, beside the columns of its run."""
    pairs = F.collect_list(F.struct(F.col("scan_idx").cast("long").alias("s"), F.col("activation").cast("double").alias("v")))
    # A set number of partitions, which Spark does not merge by size: the kernels' work is in time, not in bytes.
    parts = int(activation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = activation.where("activation <> 0").withColumn("id", F.col("id").cast("long")).repartition(parts, "id")
    own = rows.groupBy("id", *by).agg(pairs.alias("p"))
    return own.select("id", *by, F.transform("p", lambda x: x["s"]).alias("_as"), F.transform("p", lambda x: x["v"]).alias("_av"))


def on_grids(series: DataFrame, scans: DataFrame, kernel, schema, by: list[str] = (), most: int = 500) -> DataFrame:
    """Rows of ``kernel(series, scans, times)`` for the series of each run with its scans in order.

    A run's series are dealt over groups of about ``most``; its scans, 16 bytes each, are sent to each of its groups, so neither a
    long run nor many runs meet in one task, and nothing is broadcast.
    """
    keys = list(by) or ["_run"]
    if not by:
        series, scans = (df.withColumn("_run", F.lit(0)) for df in (series, scans))
    groups = series.groupBy(*(F.col(k).alias(k) for k in keys)).agg(F.ceil(F.count("*") / most).cast("int").alias("_groups"))
    dealt = series.join(groups, keys).withColumn("_group", F.pmod(F.xxhash64("id"), F.col("_groups")).cast("int")).drop("_groups")
    # Named anew, as both sides may come from one table of runs.
    grid = scans.select(*(F.col(k).alias(k) for k in keys), F.col("scan_idx").cast("long").alias("_s"), F.col("starttime").cast("double").alias("_t"))
    grid = grid.join(groups, keys).withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(own: pa.Table, header: pa.Table) -> pa.Table:
        header = header.sort_by("_s")
        return kernel(own, header.column("_s").to_numpy(), header.column("_t").to_numpy())

    both = (df.repartition(parts, *keys, "_group").groupBy(*keys, "_group") for df in (dealt, grid))
    left, right = both
    return left.cogroup(right).applyInArrow(run, schema)


def dense_rows(series: pa.Table, grid: np.ndarray):
    """For each series: id, and the places and values of its activations among the scans of ``grid``."""
    lists = [series.column(c).combine_chunks() for c in ("_as", "_av")]
    for k, i in enumerate(series.column("id").to_pylist()):
        scan, act = (x[k].values.to_numpy(zero_copy_only=False) for x in lists)
        place = np.minimum(np.searchsorted(grid, scan), max(len(grid) - 1, 0))
        known = grid[place] == scan if len(grid) else np.zeros(len(scan), bool)
        yield i, place[known], act[known]


def series_sums(activation: DataFrame, scans: DataFrame, suffix: str = "Raw", by: list[str] = ()) -> DataFrame:
    """Sum, area and trapezoid integral of each series; both integrals are weighted sums over non-zero scans."""
    weights = half_gaps(scans.select("scan_idx", "starttime", *by), "starttime", group=list(by)).select("scan_idx", "weight")
    joined = activation.select("id", "scan_idx", "activation").join(weights, "scan_idx")
    area = F.sum(F.col("activation") * F.col("weight"))
    return joined.groupBy("id").agg(F.sum("activation").alias(f"SumActivation{suffix}"), area.alias(f"AUCActivation{suffix}"), area.alias(f"TRPZActivation{suffix}"))
