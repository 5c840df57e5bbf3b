"""Label files: which are read, how they are named, and how they load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.settings import DEFAULT

#: The accepted extensions and the size limit of one request.
EXTENSIONS, MAX_BYTES = ("jpeg", "jpg", "pdf", "png", "webp"), DEFAULT.max_bytes


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def is_allowed(name: Column) -> Column:
    return F.coalesce(extension(name).isin(*EXTENSIONS), F.lit(False))


def unique_name(name: Column, seed: Column | None = None) -> Column:
    """stem_<12 hex digits>.ext; the digits come from seed where one is given, else at random."""
    digits = F.substring(F.sha2(seed, 256), 1, 12) if seed is not None else F.substring(F.replace(F.uuid(), F.lit("-")), 1, 12)
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), digits, F.lit("."), extension(name))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the label files under path; the filters reach the listing, and content is read last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(is_allowed(F.col("path")) & (F.col("length") > 0) & (F.col("length") <= MAX_BYTES))


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comparison results posted as JSON."""
    return spark.read.schema(schema).json(path)


def public_url(path: Column) -> Column:
    """The served address of a stored file, by its folder."""
    parent, name = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1)
    return F.when(path.rlike(".*/uploads/[^/]+$") & (parent == "uploads"), F.concat(F.lit("/uploads/"), name)).when(path.rlike(".*/outputs/[^/]+$") & (parent == "outputs"), F.concat(F.lit("/outputs/"), name)).otherwise(path)
