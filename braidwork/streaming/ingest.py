"""Chunk files as a stream: typed rows without repeats, running counts, and recalibrated pulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlap as O

SCHEMA = "series_id string, pull_id string, chunk_id string, historical_date date, value double, collection_day int, stream_id string, replicate_id string, window_start date, window_end date, retrieved_at timestamp"
KEY = ["series_id", "pull_id", "chunk_id", "historical_date"]


def chunk_stream(spark: SparkSession, path: str, late: str = "7 days", files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet chunk files below ``path``; a key that comes again within the watermark is dropped."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withWatermark("retrieved_at", late).dropDuplicatesWithinWatermark(KEY)


def retrieval_counts(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Rows, zeros and the mean by window of retrieval and stream; late rows beyond the watermark are left out."""
    return stream.groupBy(F.window("retrieved_at", width), "series_id", "stream_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value") == 0).alias("n_zeros"), F.avg("value").alias("mean_value"))


def recalibrate_touched(history: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], settings: O.Calibration = O.Calibration()):
    """A ``foreachBatch`` function: the pulls that a batch touches are calibrated again over their history.

    ``history`` reads the observations stored so far, the batch's among them; ``sink`` takes the new
    series of those pulls with the batch's number, so that writing can be made idempotent.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("series_id", "pull_id").distinct()
        rows = history().join(touched, ["series_id", "pull_id"], "left_semi")
        sink(O.calibrate(rows, settings=settings).series, batch_id)

    return run
