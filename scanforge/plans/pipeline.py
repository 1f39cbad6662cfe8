"""The whole analysis: from spectra and candidates to quantities, peaks and their comparison."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge import schemas
from scanforge.functions import kernels
from scanforge.functions.scalar import search_range
from scanforge.operators import compare, dictionary, peaks, smooth, solve
from scanforge.sources import files


@dataclass
class Config:
    """Job settings, checked when made."""

    scans: str = ""
    reference: str = ""
    experiment: str = ""
    out: str = ""
    rt_tol: float = 1.0
    rt_ref: str = "pred"
    iso_ab_mis_thres: float = 0.5
    alpha_criteria: str = "convergence"
    opt_algo: str = "threshold"
    alphas: list[float] = field(default_factory=list)
    corr_thres: float = 0.95
    PS_cos_dist: bool = True
    notes: str = ""

    def __post_init__(self):
        for name, allowed in (("rt_ref", ("exp", "pred", "mix")), ("alpha_criteria", ("min", "convergence")), ("opt_algo", kernels.ALGORITHMS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.rt_tol <= 0 or not 0 <= self.iso_ab_mis_thres <= 1:
            raise ValueError("rt_tol must be positive and iso_ab_mis_thres from 0 to 1")
        if self.opt_algo == "threshold":
            self.alphas = []

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        return cls(**files.read_json_config(spark, path))

    @property
    def name(self) -> str:
        """The settings that matter most, and a digest of all of them but ``out``, inputs included."""
        digest = hashlib.sha256(json.dumps({k: v for k, v in asdict(self).items() if k != "out"}, sort_keys=True).encode()).hexdigest()[:12]
        stem = self.scans.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        parts = [stem, f"rt_{self.rt_ref}_{self.rt_tol:g}", f"mis_{self.iso_ab_mis_thres:g}", self.opt_algo, self.alpha_criteria, *(["PScosdist"] if self.PS_cos_dist else []), self.notes, digest]
        return "_".join(p for p in parts if p)

    @property
    def folder(self) -> str:
        return f"{self.out}/{self.name}"

    def table(self, name: str) -> str:
        """Where a table of this job lies."""
        return f"{self.folder}/{name}"

    def effective(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)


def with_search_range(reference: DataFrame, config: Config) -> DataFrame:
    return reference.withColumns(search_range(config.rt_ref, config.rt_tol))


def process_scans(scans: DataFrame, reference: DataFrame, config: Config, by: list[str] = ()) -> dict[str, DataFrame]:
    """Activations, collinear neighbours, components of candidates and scan records; all long and keyed.

    Shuffles are by ``scan_idx`` and, within it, by ``apex_mz`` or ``id``. ``by`` names the columns of the run in both
    tables, whose scans and candidates then have numbers of their own (see ``plans.runs``).
    """
    found = dictionary.scan_peaks(scans)
    candidates = dictionary.candidates_by_time(scans, reference.select("id", *by, "RT_search_left", "RT_search_right", "IsoMZ", "IsoAbundance"), 2 * config.rt_tol, by)
    matches = dictionary.match_isotopes(candidates, found)
    design = dictionary.build_dictionary(matches, config.iso_ab_mis_thres)
    observed = dictionary.observations(found)
    if config.opt_algo == "threshold":
        act = solve.threshold_activation(design, observed).withColumn("alpha", F.lit(0.0))
    else:
        act = solve.lasso_activation(design, observed, config.alphas, config.opt_algo, criteria=config.alpha_criteria).drop("score")
    fit = solve.reconstruct(design, act, observed)
    times = scans.select("scan_idx", "starttime")
    if config.PS_cos_dist:
        act = act.join(solve.leave_one_out(design, act, fit), ["scan_idx", "id"], "left")
    else:
        act = act.withColumn("cos_dist", F.lit(None).cast("double"))
    activation = act.join(times, "scan_idx").select("id", "scan_idx", "starttime", "activation", "cos_dist")
    pairs = dictionary.feature_correlation(design, observed.groupBy("scan_idx").agg(F.count("*").alias("n")), config.corr_thres)
    near = dictionary.neighbours(pairs)
    by_time = candidates.groupBy("scan_idx").agg(F.array_sort(F.collect_list("id")).alias("candidates_by_rt"))
    kept = act.groupBy("scan_idx").agg(F.array_sort(F.collect_list("id")).alias("filtered_candidates"), F.max("alpha").alias("best_alpha"))
    collinear = near.groupBy("scan_idx").agg(F.count("*").alias("n_collinear"))
    metrics = solve.fit_metrics(fit).select("scan_idx", "cos_dist", "intensity_explained")
    record = times.join(by_time, "scan_idx", "left").join(kept, "scan_idx", "left").join(collinear, "scan_idx", "left").join(metrics, "scan_idx", "left")
    return {"activation": activation, "neighbours": near, "pairs": pairs, "records": record.select(*schemas.SCAN_RECORD.names)}


def quantify(activation: DataFrame, scans: DataFrame, reference: DataFrame, n_peaks: int = 1, by: list[str] = ()) -> dict[str, DataFrame]:
    """Raw and smoothed series with their sums, elution peaks of the repaired series and their areas; over the scans of each run if ``by`` names its columns."""
    of_run = (lambda df: df.join(reference.select("id", *by), "id")) if by else (lambda df: df)
    gaussian = smooth.gaussian_smooth(activation)
    minima = smooth.local_minima_smooth(of_run(activation), scans, by=by)
    found = peaks.elution_peaks(of_run(minima), scans, reference, n_peaks, by=by)
    sums = {name: smooth.series_sums(df, scans, suffix, by) for name, df, suffix in (("sum_raw", activation, "Raw"), ("sum_gaussian", gaussian, "GaussianKernel"), ("sum_minima", minima, "LocalMinima"))}
    return {"gaussian": gaussian, "minima": minima, "peaks": found, **sums, "sum_peak": peaks.peak_area(found)}


def run_pipeline(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Runs all stages from the configured tables (parquet) and writes each under ``out``.

    What is there is read, not made, unless an input has changed since.
    """
    scans, experiment = spark.read.schema(schemas.SCANS).parquet(config.scans), spark.read.parquet(config.experiment)
    root = config.folder
    spark.createDataFrame([(config.effective(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/config")
    kept = partial(files.cached, spark, inputs=[config.scans, config.reference, config.experiment])
    reference = kept(f"{root}/reference", lambda: with_search_range(spark.read.parquet(config.reference), config))
    steps = process_scans(scans, reference, config)
    out = {k: kept(f"{root}/{k}", lambda v=v: v) for k, v in steps.items()}
    out |= {k: kept(f"{root}/{k}", lambda v=v: v) for k, v in quantify(out["activation"], scans, reference).items()}
    comparison = compare.Comparison(reference, experiment, [out["sum_raw"], out["sum_gaussian"], out["sum_minima"], out["sum_peak"]])
    out["merged"] = kept(f"{root}/merged", comparison.with_intensity)
    out["matched_peaks"] = kept(f"{root}/matched_peaks", lambda: peaks.match_peaks(out["peaks"], out["merged"]))
    out["target_decoy"] = kept(f"{root}/target_decoy", comparison.target_decoy)
    out["overlap"] = kept(f"{root}/overlap", comparison.overlap)
    return out


def run_batch(spark: SparkSession, configs: list[Config]) -> dict[str, dict[str, DataFrame]]:
    """Several jobs one after the other, by the name of each."""
    return {c.name: run_pipeline(spark, c) for c in configs}


def extract_peaks(spark: SparkSession, config: Config, n_peaks: int = 1) -> dict[str, DataFrame]:
    """Peaks of a job whose activations are there already, with their match to the measured ones."""
    kept = partial(files.cached, spark, inputs=[config.scans, config.experiment, config.table("reference"), config.table("activation")])
    scans, experiment = spark.read.schema(schemas.SCANS).parquet(config.scans), spark.read.parquet(config.experiment)
    reference, activation = spark.read.parquet(config.table("reference")), spark.read.parquet(config.table("activation"))
    repaired = smooth.local_minima_smooth(activation, scans)
    found = kept(config.table(f"peaks_{n_peaks}"), lambda: peaks.elution_peaks(repaired, scans, reference, n_peaks))
    merged = compare.Comparison(reference, experiment, [peaks.peak_area(found)]).with_intensity()
    return {"peaks": found, "matched": kept(config.table(f"matched_peaks_{n_peaks}"), lambda: peaks.match_peaks(found, merged, n_peaks))}
