"""Comparison of activations with independently measured intensities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions.scalar import MEETING, composite_key
from scanforge.operators.aggregates import summarise, target_decoy
from scanforge.operators.joins import overlap_label, right_join_indicator
from scanforge.operators.metrics import regression
from scanforge.operators.sets import venn
from scanforge.operators.windows import keep_unique

KEYS = ["Modified sequence", "Charge"]
RANGE = ["RT_search_left", "RT_search_right", "Calibrated retention time start", "Calibrated retention time finish"]


def merge_experiment(reference: DataFrame, experiment: DataFrame) -> DataFrame:
    """All measured rows with their candidate, if there is one; ``_merge`` tells which have one."""
    shared = [c for c in reference.columns if c in experiment.columns and c not in KEYS]
    return right_join_indicator(reference.drop(*shared), experiment, KEYS)


def label_overlap(merged: DataFrame, labels: str = "reference") -> DataFrame:
    return merged.withColumn("RT_overlap", overlap_label(*RANGE, labels=labels))


def filter_overlap(merged: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    return merged.where(F.col("RT_overlap").isin(list(wanted or MEETING)))


def sum_intensity(merged: DataFrame) -> DataFrame:
    """One row for each sequence and charge: summed intensity, median, least and greatest times, first candidate."""
    first = [c for c in ("id", "Reverse") if c in merged.columns]
    order = ["Calibrated retention time", "Intensity"]
    out = summarise(merged, KEYS, first, order, median=["Calibrated retention time"], total=["Intensity"], least=["Calibrated retention time start"], most=["Calibrated retention time finish"])
    return out.withColumnsRenamed({"Calibrated retention time_median": "Calibrated retention time", "Intensity_sum": "Intensity", "Calibrated retention time start_min": "Calibrated retention time start", "Calibrated retention time finish_max": "Calibrated retention time finish"})


def add_sums(merged: DataFrame, sums: DataFrame) -> DataFrame:
    """Measured rows with their candidate's activation sums; rows without a candidate stay."""
    return sums.join(merged, "id", "right")


@dataclass
class Comparison:
    """Candidates, measurements and activation sums, all keyed by ``id``."""

    reference: DataFrame
    experiment: DataFrame
    sums: list[DataFrame] = field(default_factory=list)
    sum_cols: list[str] | None = None

    def __post_init__(self):
        if not self.sums:
            raise ValueError("at least one table of sums is needed")
        self.joined = self.sums[0]
        for more in self.sums[1:]:
            self.joined = self.joined.join(more, "id", "full")
        if self.sum_cols is None:
            self.sum_cols = [c for c in self.joined.columns if c.startswith(("Sum", "AUC", "TRPZ"))]
        self.decoys = self.reference.select("id", F.when(F.col("Reverse").isNull(), 0).otherwise(1).alias("Decoy"))

    def active(self) -> DataFrame:
        """Candidates whose first sum is positive."""
        return self.joined.where(F.col(self.sum_cols[0]) > 0)

    def with_intensity(self, by_overlap: list[str] | None = None, repeated: str = "agg", labels: str = "reference") -> DataFrame:
        """Measured rows with a candidate and positive activation. repeated: drop, agg or preserve repeated keys."""
        merged = label_overlap(merge_experiment(self.reference, self.experiment), labels)
        if by_overlap is not None:
            merged = filter_overlap(merged, by_overlap or None)
        if repeated == "drop":
            merged = keep_unique(merged, KEYS)
        elif repeated == "agg":
            merged = sum_intensity(merged)
        elif repeated != "preserve":
            raise ValueError(f"unknown handling {repeated}")
        return add_sums(merged, self.joined).where(F.col(self.sum_cols[0]) > 0)

    def intensity_fit(self, column: str | None = None, **options) -> DataFrame:
        """Correlation and line of log10 activation sum against log10 intensity."""
        column = column or self.sum_cols[0]
        rows = self.with_intensity(**options).where((F.col("Intensity") > 0) & (F.col(column) > 0))
        return regression(rows, F.log10("Intensity"), F.log10(column))

    def overlap(self) -> DataFrame:
        """Keys in each region of reference, experiment and active candidates."""
        key = composite_key(F.col("Modified sequence"), F.col("Charge")).alias("key")
        active = self.reference.join(self.active().select("id"), "id", "left_semi")
        return venn({"reference": self.reference.select(key), "experiment": self.experiment.select(key), "active": active.select(key)}, "key")

    def target_decoy(self) -> DataFrame:
        """Number and mean activation of active targets (0) and decoys (1)."""
        rows = self.active().join(self.reference.select("id", "Reverse"), "id")
        return target_decoy(rows, F.col("Reverse"), "id", self.sum_cols[0])
