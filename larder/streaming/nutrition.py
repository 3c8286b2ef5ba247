"""Trailing means over a stream of nutrition events, and incremental pickup of recipe files: extensions of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def trailing_means(events: DataFrame, user: str, time: str, value: str, *, window: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """A06 over sliding windows of an event stream: nulls count as zero; events later than the watermark are left out."""
    known = F.coalesce(F.col(value).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window, slide).alias("window"), user)
    means = grouped.agg(F.sum(known).alias("total"), F.count(F.lit(1)).alias("n"))
    return means.select(user, "window", (F.col("total").cast("double") / F.col("n")).alias("mean"), "n")


def import_new_files(spark: SparkSession, path: str, checkpoint: str, job: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls job with the paths of CSV files that are new since the last run; safe to repeat, as imports are idempotent by key."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv").load(path)
    return files.select("path", "length").writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
