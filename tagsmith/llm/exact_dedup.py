"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Rows are dealt into memtables by a hash of their id. A flush turns each memtable into a run: digests in order, each
with its smallest identifier and count. Compaction merges runs, keeping the smallest identifier of a digest; it is
associative, so runs of new rows can be merged into an old index at any time. The index carries a filter of the
digests that several rows share: a row whose bit is not set is unique without any look-up. Rows that pass (hits)
look their digest up and are compared with the kept row's normalised text, byte by byte; were two texts to share a
digest, the ones that differ would form groups of their own.

Defined cases: null text counts as empty, and all empty texts are one group; rows of one id with equal text share a
group and are all marked kept if that id is the smallest; an id with several texts counts in each text's group; a null id
loses to any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import attach, null_to_empty, staged, table

MEMTABLES = 16
#: Bits of the filter as a power of two: 2**24 bits are at most 512 rows of 4 KB, whatever the input.
FILTER_BITS = 24
#: Hits that compare themselves with one copy of the kept text; larger groups get several copies.
ROWS_PER_COPY = 64


def normalised(text: str) -> Column:
    return F.regexp_replace(null_to_empty(text), r"[\x20\x09-\x0D]+", " ")


def flush(digests: DataFrame, memtables: int = MEMTABLES) -> DataFrame:
    """Runs of the memtables: run, digest, keep_id, n, sorted by digest inside each file."""
    run = F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int")
    runs = digests.groupBy(run.alias("run"), "digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return staged(runs.sortWithinPartitions("run", "digest"), "lsm-run")


def compact(*runs: DataFrame) -> DataFrame:
    """One run of several; also merges runs into an index of before."""
    rows = runs[0].select("digest", "keep_id", "n")
    for more in runs[1:]:
        rows = rows.unionByName(more.select("digest", "keep_id", "n"))
    merged = rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return staged(merged.sortWithinPartitions("digest"), "lsm-index")


def _place() -> Column:
    return F.xxhash64("digest").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def shared_filter(index: DataFrame) -> DataFrame:
    """bucket, bits: the filter of the digests with several rows."""
    place = _place()
    rows = index.where("n > 1").select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit(32767)).alias("p"))
    return staged(rows.groupBy("bucket").agg(F.bitmap_construct_agg("p").alias("bits")), "lsm-filter")


def _passes(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Adds hit: whether the row's bit is set. A filter has at most 512 rows, so it is broadcast."""
    place = _place()
    p = place.bitwiseAND(F.lit(32767)).cast("int")
    rows = rows.withColumns({"bucket": F.shiftright(place, 15), "__p": p}).join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, __p div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright({}, __p % 8)".format("__byte")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return rows.withColumn("__byte", byte).withColumn("hit", hit).drop("bucket", "bits", "__p", "__byte")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
    rows = rows.select("id", F.unhex(F.sha2("norm", 256)).alias("digest"), "norm")
    digests = staged(rows.select("id", "digest"), "lsm-digests")
    index = compact(flush(digests))
    bits = shared_filter(index)

    unique = _passes(digests, bits).where("not hit").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    hits = _passes(rows, bits).where("hit").drop("hit")
    shared = index.where("n > 1").select("digest", "keep_id", F.col("n").alias("group_size"), F.col("n").alias("weight"))
    hits = attach(hits, shared, ["digest"], "weight", digests.count())
    hits = staged(hits, "lsm-hits")
    unique = unique.unionByName(hits.where("group_size is null").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))

    # byte verification: each hit against a copy of the kept row's text; large groups get a copy for every few rows
    hits = hits.where("group_size is not null")
    copies = F.ceil(F.col("group_size") / ROWS_PER_COPY).cast("int")
    kept = hits.where("id <=> keep_id").groupBy("digest").agg(F.min("norm").alias("kept_norm"), F.max("group_size").alias("group_size"))
    kept = kept.select("digest", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "kept_norm")
    dealt = hits.withColumn("copy", F.pmod(F.xxhash64("id", "digest"), copies.cast("long")).cast("int"))
    checked = dealt.join(kept, ["digest", "copy"], "left").withColumn("same", F.col("norm").eqNullSafe(F.col("kept_norm")))
    checked = staged(checked.select("id", "digest", "keep_id", "group_size", "same", F.when(~F.col("same"), F.col("norm")).alias("other")), "lsm-checked")
    same = checked.where("same")
    other = checked.where("not same")
    if other.limit(1).count():  # texts that share a digest: the rows that differ group by their bytes
        less = other.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        same = same.join(less, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("less", F.lit(0)))
        groups = other.groupBy("digest", "other").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        same = same.select("id", "digest", "keep_id", "group_size").unionByName(other.select("id", "digest", "other").join(groups, ["digest", "other"]).select("id", "digest", "keep_id", "group_size"))
    out = unique.unionByName(same.select("id", "digest", "keep_id", "group_size"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op5_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole of documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
