"""Samples that arrive more than once and late: one row a sample, and sessions of a line's work, with bounded state.

A watermark says how late a row may be. Repeats within it are dropped by state that ends with it; sessions close once the
watermark has passed their gap. Over the same rows a batch gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of events as they land, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key; a stream forgets a key when late has passed since."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def sessions(events: DataFrame, by: str, time: str, value: str, gap: str) -> DataFrame:
    """by, begin, end, n, total of each run of events with less than gap between neighbours."""
    rows = events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return rows.select(by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "total")


def write_sessions(events: DataFrame, key: str, by: str, time: str, value: str, late: str, gap: str, out: str, checkpoint: str):
    """Start the query that appends each session of deduplicated events as Parquet once it can grow no more."""
    rows = sessions(once(events, key, time, late), by, time, value, gap)
    return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
