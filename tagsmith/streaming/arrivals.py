"""Samples that arrive over time, checked against stored approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagsmith.plans.label_qc import pair_summary


def sample_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of (pair_id, group_id, stext) as they land."""
    return spark.readStream.schema("pair_id long, group_id long, stext string").parquet(path)


def check_arrivals(samples: DataFrame, approvals: DataFrame, out: str, checkpoint: str):
    """Start the query that writes a summary row per arriving sample. approvals: (group_id, atext).

    Each micro-batch is a stream-static join and then the batch plan; a batch is written under its number, so a
    batch that runs twice overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        pairs = batch.join(approvals, "group_id").select("pair_id", "atext", "stext")
        pair_summary(pairs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
