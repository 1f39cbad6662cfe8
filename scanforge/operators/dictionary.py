"""Candidate dictionaries of spectra in long form, and links between candidates alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge import schemas
from scanforge.functions import kernels
from scanforge.operators.joins import asof_nearest, band_join
from scanforge.operators.reshape import explode_pairs


def scan_peaks(scans: DataFrame, rel_height: float = 0.75, distance: int | None = None, prominence: float | None = None) -> DataFrame:
    """The peaks of each spectrum, one row each; no shuffle, as a spectrum is one row."""

    def pick(batches):
        for b in batches:
            rows = {n: [] for n in schemas.PEAKS.names}
            arrays = [b.column(c) for c in ("mzarray", "intarray")]
            for k, scan in enumerate(b.column("scan_idx").to_pylist()):
                # The numbers of an array stay where Arrow has them.
                x, y = (a[k].values.to_numpy(zero_copy_only=False) if a[k].is_valid else [] for a in arrays)
                found = kernels.spectrum_peaks(x, y, rel_height, distance, prominence)
                rows["scan_idx"] += [scan] * len(found["apex_mz"])
                for n, v in found.items():
                    rows[n] += v.tolist()
            yield pa.RecordBatch.from_pydict(rows, pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.float64()) for f in schemas.PEAKS]))

    return scans.select("scan_idx", "mzarray", "intarray").mapInArrow(pick, schemas.PEAKS)


def spectrum_summary(peaks: DataFrame) -> DataFrame:
    """Number, mean and sample deviation of the peak sums of each spectrum."""
    return peaks.groupBy("scan_idx").agg(F.count("*").alias("n"), F.avg("peak_intensity_sum").alias("mean"), F.stddev("peak_intensity_sum").alias("std"))


def candidates_by_time(scans: DataFrame, reference: DataFrame, width: float, by: list[str] = ()) -> DataFrame:
    """Candidates whose search range holds a scan's start time, of the same run if ``by`` names its columns."""
    return band_join(scans.select("scan_idx", "starttime", *by), reference, "starttime", "RT_search_left", "RT_search_right", width, list(by))


def match_isotopes(candidates: DataFrame, peaks: DataFrame) -> DataFrame:
    """Each theoretical isotope with the peak of its scan whose apex is nearest, and whether it lies in that peak."""
    isotopes = explode_pairs(candidates, ["scan_idx", "id"], ["IsoMZ", "IsoAbundance"])
    near = asof_nearest(isotopes, peaks, "IsoMZ", "apex_mz", ["scan_idx"], "apex_mzidx", ["apex_mz", "start_mz", "end_mz"])
    inside = (F.col("IsoMZ") >= F.col("start_mz")) & (F.col("IsoMZ") <= F.col("end_mz"))
    return near.withColumn("matched", F.coalesce(inside, F.lit(False)))


def build_dictionary(matches: DataFrame, missing: float = 0.4) -> DataFrame:
    """``(scan_idx, apex_mz, id, abundance)`` of candidates with at least 1 - ``missing`` of their abundance matched.

    A row at 0 holds a candidate's abundance that no peak observed, so its column sums to 1.
    """
    placed = matches.where("matched").groupBy("scan_idx", "id", "apex_mz").agg(F.sum("IsoAbundance").alias("abundance"))
    seen = placed.groupBy("scan_idx", "id").agg(F.sum("abundance").alias("seen")).where(F.col("seen") >= 1 - missing)
    kept = placed.join(seen.select("scan_idx", "id"), ["scan_idx", "id"]).select("scan_idx", "apex_mz", "id", "abundance")
    return kept.unionByName(seen.select("scan_idx", F.lit(0.0).alias("apex_mz"), "id", (1 - F.col("seen")).alias("abundance")))


def observations(peaks: DataFrame) -> DataFrame:
    """``(scan_idx, apex_mz, intensity)`` with nothing observed at 0."""
    rows = peaks.select("scan_idx", "apex_mz", F.col("peak_intensity_sum").alias("intensity"))
    return rows.unionByName(peaks.select("scan_idx").distinct().select("scan_idx", F.lit(0.0).alias("apex_mz"), F.lit(0.0).alias("intensity")))


def feature_correlation(dictionary: DataFrame, sizes: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of candidates of a scan whose columns correlate at ``threshold`` (over 0) or more, with the Jaccard of their rows.

    ``sizes(scan_idx, n)`` has the rows of a scan's column, zeros included. Candidates that
    share no row correlate negatively, so only pairs that share one are made. The row at 0, which
    nearly all candidates share, is left out of that join: its product comes from the two
    candidates' own values. Pairs that share nothing else are made only of candidates whose
    value there is so large a part of them that a correlation of ``threshold`` is in reach.
    """
    square, real = F.col("abundance") * F.col("abundance"), F.col("apex_mz") != 0
    unseen = F.sum(F.when(~real, F.col("abundance")).otherwise(0.0)).alias("u")
    moments = dictionary.groupBy("scan_idx", "id").agg(F.sum("abundance").alias("s"), F.sum(square).alias("q"), F.count_if(F.col("abundance") > 0).alias("k"), unseen)
    moments = moments.join(sizes, "scan_idx")
    a = dictionary.where(real).select("scan_idx", "apex_mz", F.col("id").alias("a"), F.col("abundance").alias("x"))
    b = dictionary.where(real).select("scan_idx", "apex_mz", F.col("id").alias("b"), F.col("abundance").alias("y"))
    shared = a.join(b, ["scan_idx", "apex_mz"]).where("a < b").groupBy("scan_idx", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("both"))
    # r is at most the product of two candidates' parts, if they share the row at 0 alone.
    part = F.sqrt(F.col("n")) * F.col("u") / F.sqrt(F.col("n") * F.col("q") - F.col("s") * F.col("s"))
    parts = moments.where((F.col("u") > 0) & (F.col("n") * F.col("q") > F.col("s") * F.col("s"))).select("scan_idx", "id", part.alias("part"))
    most = parts.groupBy("scan_idx").agg(F.max("part").alias("most"))
    large = parts.join(most, "scan_idx").where(F.col("part") * F.col("most") >= threshold * (1 - 1e-9)).select("scan_idx", "id")
    alone = large.withColumnRenamed("id", "a").join(large.withColumnRenamed("id", "b"), "scan_idx").where("a < b").select("scan_idx", "a", "b", F.lit(0.0).alias("xy"), F.lit(0).cast("long").alias("both"))
    pairs = shared.union(alone).groupBy("scan_idx", "a", "b").agg(F.sum("xy").alias("xy"), F.sum("both").alias("both"))
    side = lambda name: moments.select("scan_idx", F.col("id").alias(name), *(F.col(c).alias(f"{c}{name}") for c in "squk"))
    full = pairs.join(side("a"), ["scan_idx", "a"]).join(side("b"), ["scan_idx", "b"]).join(sizes, "scan_idx")
    full = full.withColumn("xy", F.col("xy") + F.col("ua") * F.col("ub")).withColumn("both", F.col("both") + ((F.col("ua") > 0) & (F.col("ub") > 0)).cast("long"))
    top = F.col("n") * F.col("xy") - F.col("sa") * F.col("sb")
    spread = (F.col("n") * F.col("qa") - F.col("sa") * F.col("sa")) * (F.col("n") * F.col("qb") - F.col("sb") * F.col("sb"))
    r = F.when(spread > 0, top / F.sqrt(spread))
    jaccard = F.try_divide(F.col("both").cast("double"), (F.col("ka") + F.col("kb") - F.col("both")).cast("double"))
    return full.select("scan_idx", "a", "b", r.alias("r"), jaccard.alias("jaccard")).where(F.col("r") >= threshold)


def neighbours(pairs: DataFrame) -> DataFrame:
    """Sorted direct neighbours of each candidate of a scan."""
    both = pairs.select("scan_idx", F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("scan_idx", "b", "a"))
    return both.groupBy("scan_idx", "id").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def components(pairs: DataFrame, group: str = "scan_idx") -> DataFrame:
    """``(group, id, component)``: the smallest id that links reach.

    Links never leave their scan, and a scan's are at most some for each of its candidates: one pass
    over them, by scan.
    """

    def label(t: pa.Table) -> pa.Table:
        ids, place = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        a, b = place[: t.num_rows], place[t.num_rows :]
        least, before = np.arange(len(ids)), None
        while before is None or (least != before).any():
            before = least.copy()
            low = np.minimum(least[a], least[b])
            for side in (a, b):
                np.minimum.at(least, side, low)
                np.minimum.at(least, before[side], low)
            least = least[least]
        return pa.table({group: pa.array([t.column(group)[0].as_py()] * len(ids), t.schema.field(group).type), "id": ids, "component": ids[least]})

    kind = pairs.schema[group].dataType.simpleString()
    rows = pairs.select(group, F.col("a").cast("long"), F.col("b").cast("long"))
    return rows.groupBy(group).applyInArrow(label, f"`{group}` {kind}, id long, component long")
