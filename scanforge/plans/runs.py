"""Several runs in one table, analysed in one job.

Each run's scans and candidates get numbers of their own, the run's in the upper bits, so all that is keyed
by scan or candidate works as it is; what goes by time or over all scans of a run is given the run's column.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.plans.pipeline import Config, process_scans, quantify, with_search_range
from scanforge.session import checkpointed
from scanforge.sources import files

#: Bits of a scan's or candidate's own number.
BITS = 40
RUN = "_run_no"
#: Columns that hold such numbers, one or an array of them.
NUMBERED = {"id", "scan_idx", "a", "b", "apex_scan", "start_scan", "end_scan"}
LISTED = {"neighbours", "candidates_by_rt", "filtered_candidates"}


def number_runs(scans: DataFrame, run: str = "run") -> DataFrame:
    """``(run, _run_no)``, one row a run; only the distinct names are sorted in one task."""
    names = scans.where(F.col(run).isNotNull()).select(run).distinct()
    return names.withColumn(RUN, (F.row_number().over(Window.orderBy(run)) - 1).cast("long"))


def _own(number: str) -> Column:
    n = F.col(number)
    fits = (n >= 0) & (n < 1 << BITS)
    return F.when(fits, F.shiftleft(F.col(RUN), BITS) + n).otherwise(F.raise_error(F.concat(F.lit(f"{number} must be from 0 to below 2^{BITS}, not "), F.coalesce(n.cast("string"), F.lit("null")))))


def join_runs(scans: DataFrame, reference: DataFrame, runs: DataFrame, run: str = "run") -> tuple[DataFrame, DataFrame]:
    """Both tables with numbers of their run. Candidates without a column of the run are looked for in each run."""
    numbered = scans.join(runs, run).withColumn("scan_idx", _own("scan_idx"))
    expected = reference.join(runs, run) if run in reference.columns else reference.crossJoin(runs)
    return numbered, expected.withColumn("id", _own("id"))


def split_runs(df: DataFrame, runs: DataFrame, run: str = "run") -> DataFrame:
    """A result with its run's name and the run's own numbers again."""
    key = F.col("scan_idx" if "scan_idx" in df.columns else "id")
    low = (1 << BITS) - 1
    named = df.withColumn(RUN, F.shiftright(key, BITS)).join(runs, RUN)
    new = {c: F.col(c).bitwiseAND(F.lit(low)) for c in NUMBERED & set(df.columns)}
    new |= {c: F.transform(c, lambda x: x.bitwiseAND(F.lit(low))) for c in LISTED & set(df.columns)}
    return named.select(run, *(new.get(c, F.col(c)).alias(c) for c in df.columns))


def _numbered(scans: DataFrame, reference: DataFrame, config: Config, run: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs = number_runs(scans, run)
    return runs, *join_runs(scans, with_search_range(reference, config), runs, run)


def analyse_runs(scans: DataFrame, reference: DataFrame, config: Config, run: str = "run", n_peaks: int = 1) -> dict[str, DataFrame]:
    """All that ``process_scans`` and ``quantify`` give, for each run, with the column of the run first.

    Results are those of one job a run. Rows without a run are left out; runs of a third of all scans are spread like any others.
    """
    runs, own_scans, own_reference = _numbered(scans, reference, config, run)
    out = process_scans(own_scans, own_reference, config, [RUN])
    out["activation"] = checkpointed(out["activation"])
    out |= quantify(out["activation"], own_scans, own_reference, n_peaks, [RUN])
    return {name: split_runs(df, runs, run) for name, df in out.items()}


def run_job(spark: SparkSession, config: Config, run: str = "run", n_peaks: int = 1, only: list[str] | None = None) -> dict[str, DataFrame]:
    """:func:`analyse_runs` on the configured tables, each result (or those of ``only``) written under the job's folder; what is there is read unless an input has changed.

    The table of scans holds all runs; that of candidates has a column of the run or holds for each.
    """
    scans, reference = spark.read.parquet(config.scans), spark.read.parquet(config.reference)
    kept = partial(files.cached, spark, inputs=[config.scans, config.reference])
    runs, own_scans, own_reference = _numbered(scans, reference, config, run)
    steps = process_scans(own_scans, own_reference, config, [RUN])
    # Numbers of their own stay in what the next step reads.
    numbered = kept(config.table("numbered_activation"), lambda: steps["activation"])
    out = {k: v for k, v in steps.items() if k != "activation"} | {"activation": numbered} | quantify(numbered, own_scans, own_reference, n_peaks, [RUN])
    return {name: kept(config.table(f"runs_{name}"), lambda df=df: split_runs(df, runs, run)) for name, df in out.items() if only is None or name in only}
