"""Elution peaks of activation series and their match to measured ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge import schemas
from scanforge.functions import kernels
from scanforge.operators.joins import nearest_scan
from scanforge.operators.sets import range_jaccard
from scanforge.operators.smooth import dense_rows, on_grids, series_arrays
from scanforge.operators.windows import flag_n_smallest


def elution_peaks(activation: DataFrame, scans: DataFrame, reference: DataFrame, n_peaks: int = 1, width=(2, None), height=(None, None), by: list[str] = ()) -> DataFrame:
    """Elution peaks of each candidate's series over all scans of its run; see ``kernels.elution_peaks``.

    Series are laid out from one scan before their first to one after their last non-zero
    scan, which finds the same peaks as all scans do, as what is left out is flat.
    """
    series = series_arrays(activation, by).join(reference.select("id", F.col("RT_search_center").alias("_center")), "id")
    kinds = pa.schema([(f.name, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.typeName()]) for f in schemas.ELUTION_PEAKS])

    def find(t: pa.Table, grid: np.ndarray, grid_times: np.ndarray) -> pa.Table:
        rows = {n: [] for n in schemas.ELUTION_PEAKS.names}
        for (i, place, act), centre in zip(dense_rows(t, grid), t.column("_center").to_pylist(), strict=True):
            if not len(place):
                continue
            low, high = max(int(place.min()) - 1, 0), min(int(place.max()) + 1, len(grid) - 1)
            dense = np.zeros(high - low + 1)
            dense[place - low] = act
            times, scan = grid_times[low : high + 1], grid[low : high + 1]
            found = kernels.elution_peaks(dense, times, float("nan") if centre is None else centre, n_peaks, width, height)
            rows["id"] += [i] * len(found["apex"])
            for name in ("apex", "start", "end"):
                rows[f"{name}_scan"] += scan[found[name]].tolist()
            for name in ("apex_time", "start_time", "end_time", "peak_width", "peak_height", "peak_intensity_auc", "rt_search_center_diff", "closest_to_search_center"):
                rows[name] += found[name].tolist()
        return pa.table(rows, kinds)

    return on_grids(series, scans, find, schemas.ELUTION_PEAKS, by)


def peak_area(peaks: DataFrame) -> DataFrame:
    """Summed area of the peaks nearest to the search centre, for each candidate."""
    return peaks.where("closest_to_search_center").groupBy("id").agg(F.sum("peak_intensity_auc").alias("AUCActivationPeak"))


def match_peaks(peaks: DataFrame, experiment: DataFrame, n_peaks: int = 1) -> DataFrame:
    """Peaks with their distances to the measured times of their candidate; the ``n_peaks`` nearest are matched."""
    times = ["Calibrated retention time start", "Calibrated retention time", "Calibrated retention time finish"]
    joined = peaks.join(experiment.select("id", *times), "id", "left")
    for name, mine, theirs in zip(("start", "apex", "end"), ("start_time", "apex_time", "end_time"), times, strict=True):
        joined = joined.withColumn(f"RT_{name}_diff", F.abs(F.col(mine) - F.col(theirs)))
    joined = joined.withColumn("RT_diff_sum", F.col("RT_apex_diff") + F.col("RT_start_diff") + F.col("RT_end_diff"))
    return flag_n_smallest(joined, ["id"], n_peaks, "matched", F.col("RT_diff_sum"), "apex_scan")


def demote_by_overlap(matched: DataFrame, scans: DataFrame, least: float = 0.5, by: list[str] = ()) -> DataFrame:
    """Matched peaks whose scans overlap the measured ones by a Jaccard below ``least`` lose the mark."""
    located = nearest_scan(matched, scans, ["Calibrated retention time start", "Calibrated retention time finish"], by=by)
    jaccard = range_jaccard(F.col("start_scan"), F.col("end_scan"), F.col("Calibrated retention time start_scan"), F.col("Calibrated retention time finish_scan"))
    return located.withColumn("jaccard", jaccard).withColumn("matched", F.when(F.col("jaccard") < least, False).otherwise(F.col("matched")))


def intensity_by_score(peaks: DataFrame, threshold: float = 0.05, by_matched: bool = False) -> DataFrame:
    """Summed area of the peaks that are matched, or score over ``threshold``; 0 where none is."""
    kept = F.col("matched") if by_matched else F.col("pred_score") > threshold
    return peaks.groupBy("id").agg(F.sum(F.when(kept, F.col("peak_intensity_auc")).otherwise(0.0)).alias("peak_intensity_auc"))
