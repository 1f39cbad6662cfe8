"""Spectra that arrive while the instrument runs; beyond parity, as scans are independent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge import schemas
from scanforge.plans.pipeline import Config, process_scans


def read_scans(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.SCANS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def process_stream(scans: DataFrame, reference: DataFrame, config: Config, out: str, checkpoint: str):
    """Starts a query that appends the activations of each arriving batch, marked with the batch, to ``out``.

    A batch that is run again replaces its own folder, so results appear once.
    """

    def write(batch: DataFrame, number: int) -> None:
        process_scans(batch, reference, config)["activation"].write.mode("overwrite").parquet(f"{out}/batch={number}")

    return scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_by_window(events: DataFrame, time: str, key: str, value: str, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Sum and count for each key and time window, late rows within ``late`` included."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
