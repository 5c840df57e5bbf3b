"""Comparison results posted as JSON: read permissively, what cannot be read kept apart, flattened to tables and nested again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = "field STRING, approval STRING, sample STRING, status STRING, score DOUBLE"
SAMPLE = f"filename STRING, score DOUBLE, status STRING, matched BIGINT, mismatched BIGINT, missing BIGINT, extra BIGINT, fields ARRAY<STRUCT<{FIELD}>>"
PAYLOAD = f"approval STRUCT<filename STRING, ocr_text STRING>, samples ARRAY<STRUCT<{SAMPLE}>>"
#: The columns of a posted result's first level.
KNOWN = ("approval", "samples")


def parse(bodies: DataFrame, key: str = "payload_id", body: str = "body") -> DataFrame:
    """key, body, payload, extras (names of unknown first-level members), error.

    error: "no payload" (null or blank), "not a JSON object" (broken or another kind of value), "no samples" (none listed), "unreadable
    values" (a member of another type: the rest of the payload is kept beside the error), or null.
    """
    text = F.col(body)
    parsed = F.from_json(text, f"{PAYLOAD}, bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    # only an object has keys; a broken text has none
    keys = F.json_object_keys(text)
    rows = bodies.select(key, body, parsed.alias("p"), keys.alias("keys"))
    error = (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "no payload")
        .when(F.col("keys").isNull(), "not a JSON object")
        .when(F.col("p.bad").isNotNull(), "unreadable values")
        .when(F.coalesce(F.size("p.samples"), F.lit(0)) <= 0, "no samples")
    )
    extras = F.array_sort(F.array_except("keys", F.array(*map(F.lit, KNOWN))))
    return rows.select(key, body, F.struct("p.approval", "p.samples").alias("payload"), extras.alias("extras"), error.alias("error"))


def quarantine(parsed: DataFrame, key: str = "payload_id") -> DataFrame:
    """key, body, error of the payloads that go no further; body is what was posted, to be posted again."""
    return parsed.where("error is not null").select(key, "body", "error")


def result_tables(parsed: DataFrame, key: str = "payload_id") -> tuple[DataFrame, DataFrame]:
    """(samples, fields) of the payloads without error: key, approval_file, approval_text, sample_no and a sample's values; key, sample_no, field_no and a field row's."""
    good = parsed.where("error is null").select(key, F.col("payload.approval.filename").alias("approval_file"), F.col("payload.approval.ocr_text").alias("approval_text"), F.posexplode("payload.samples").alias("sample_no", "s"))
    fields = good.select(key, "sample_no", F.posexplode("s.fields").alias("field_no", "f")).select(key, "sample_no", "field_no", "f.*")
    return good.select(key, "approval_file", "approval_text", "sample_no", "s.*").drop("fields"), fields


def _members(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ") if c.split()[0].islower()]


def nested(samples: DataFrame, fields: DataFrame, key: str = "payload_id") -> DataFrame:
    """key, body: the tables of result_tables as JSON texts again, samples and fields in order. A sample without field rows has an empty list."""
    cols = _members(FIELD)
    per_sample = fields.groupBy(key, "sample_no").agg(F.array_sort(F.collect_list(F.struct("field_no", F.struct(*cols).alias("f")))).alias("fs"))
    rows = samples.join(per_sample, [key, "sample_no"], "left")
    listed = F.coalesce(F.transform("fs", lambda f: f["f"]), F.array().cast(f"array<struct<{FIELD.replace(' STRING', ':string').replace(' DOUBLE', ':double').replace(', ', ',')}>>"))
    one = F.struct(*[c for c in samples.columns if c not in (key, "approval_file", "approval_text", "sample_no")], listed.alias("fields"))
    rows = rows.groupBy(key, "approval_file", "approval_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_no", one.alias("s")))), lambda s: s["s"]).alias("samples"))
    return rows.select(key, _json("approval_file", "approval_text").alias("body"))


def _json(file: str, text: str) -> Column:
    return F.to_json(F.struct(F.struct(F.col(file).alias("filename"), F.col(text).alias("ocr_text")).alias("approval"), F.col("samples")))
