"""Labels stored so that approvals and samples of a group lie in the same bucket: their join and what groups by it need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a stored table; both tables of a join need the same number.
BUCKETS = 64


def store_labels(labels: DataFrame, name: str, group: str = "group_id", buckets: int = BUCKETS, path: str | None = None) -> None:
    """Write labels as the table name (at path, else in the warehouse), bucketed and sorted by group; labels are dealt by bucket first, so a bucket is one file."""
    out = labels.repartition(buckets, group).write.mode("overwrite").bucketBy(buckets, group).sortBy(group)
    (out.option("path", path) if path else out).saveAsTable(name)


def stored_pairs(spark: SparkSession, approvals: str, samples: str, group: str = "group_id") -> DataFrame:
    """group, atext and the samples' columns (text as stext) of stored labels, bucket by bucket. A hot group is one bucket's; see groups.meet for those."""
    a = spark.table(approvals).select(group, F.col("text").alias("atext")).hint("merge")
    return spark.table(samples).withColumnRenamed("text", "stext").join(a, group)
