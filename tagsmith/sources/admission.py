"""Which uploaded files of a request are taken: one approval label, one or more samples, refused ones with their first failing rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsmith.operators.groups import meet
from tagsmith.sources.files import MAX_BYTES, is_allowed

#: About what a request's totals take as a row.
TOTAL_BYTES = 64
TOO_LARGE, NO_APPROVAL, APPROVAL_TYPE, NO_SAMPLE, SAMPLE_TYPE = "request is too large", "no approval label", "unsupported approval type", "no sample label", "unsupported sample type"
EMPTY, SECOND, OTHER = "empty entry", "second approval label", "another file of the request is refused"


def request_totals(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """request_id, bytes, samples, first_approval, refusal (null if the request is taken) of files (request_id, role, position, name, length).

    The rules in order: all files together are not larger than limit; there is an approval with a name; its type is allowed;
    there is a sample with a name; all samples' types are allowed. Totals are sums by request, added up before the shuffle.
    """
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    approval, sample = (F.col("role") == "approval") & named, (F.col("role") == "sample") & named
    first = F.min(F.when(approval, F.struct("position", is_allowed(F.col("name")).alias("allowed"))))
    rows = files.groupBy("request_id").agg(F.sum(F.coalesce("length", F.lit(0))).alias("bytes"), F.count_if(sample).alias("samples"), first.alias("approval"), F.count_if(sample & ~is_allowed(F.col("name"))).alias("bad"))
    refusal = F.when(F.col("bytes") > limit, TOO_LARGE).when(F.col("approval").isNull(), NO_APPROVAL).when(~F.col("approval.allowed"), APPROVAL_TYPE).when(F.col("samples") == 0, NO_SAMPLE).when(F.col("bad") > 0, SAMPLE_TYPE)
    return rows.select("request_id", "bytes", "samples", F.col("approval.position").alias("first_approval"), refusal.alias("refusal"))


def admit(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """files with admitted and reason (null if admitted).

    A file of a refused request that breaks no rule itself is refused because another one does, but where the request as a whole
    is too large or lacks a label, which is then its reason. Empty entries and approvals beside the first are refused alone.
    A request may hold any share of all files.
    """
    totals = request_totals(files, limit).persist()
    rows = meet(files, totals, "request_id", totals.count() * TOTAL_BYTES, "name")
    name = F.coalesce(F.col("name"), F.lit(""))
    is_approval = F.col("role") == "approval"
    whole = F.col("refusal").isin(TOO_LARGE, NO_APPROVAL, NO_SAMPLE)
    reason = (
        F.when(F.col("refusal") == TOO_LARGE, TOO_LARGE)
        .when(name == "", EMPTY)
        .when(is_approval & (F.col("position") > F.col("first_approval")), SECOND)
        .when(is_approval & ~is_allowed(name), APPROVAL_TYPE)
        .when(~is_approval & ~is_allowed(name), SAMPLE_TYPE)
        .when(whole, F.col("refusal"))
        .when(F.col("refusal").isNotNull(), OTHER)
    )
    rows = rows.select(*files.columns, reason.alias("reason"))
    return rows.withColumn("admitted", F.col("reason").isNull())


def admitted_labels(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approvals, samples) of admitted files: group_id, name; and group_id, sample_no (from 0, by position), name."""
    rows = admitted.where("admitted").withColumnRenamed("request_id", "group_id")
    number = F.row_number().over(Window.partitionBy("group_id").orderBy("position", "name")) - 1
    return rows.where("role = 'approval'").select("group_id", "name"), rows.where("role = 'sample'").select("group_id", number.alias("sample_no"), "name")
