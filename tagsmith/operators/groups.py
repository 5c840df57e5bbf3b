"""One approval label and its many samples: each label is read once, every sample meets its group's approval, results nest by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions.aliases import FIELDS
from tagsmith.operators import compare, fields
from tagsmith.sources.shared import kept

#: Approvals whose texts together are at most this long are broadcast; others are shuffled.
BROADCAST_BYTES = 32 << 20
#: A group with at least this share of all samples is dealt to COPIES of its approval when approvals are shuffled.
HOT_SHARE, COPIES = 0.001, 32
#: Samples of one result record, so that no group makes a row that grows with it.
RECORD_SAMPLES = 100


def meet(samples: DataFrame, approvals: DataFrame, group: str, size: int, spread: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """samples joined with approvals (one row a group, size bytes in all). Samples of hot groups are dealt by a hash of spread."""
    if size <= limit:
        return samples.join(F.broadcast(approvals), group)
    counts = samples.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    # at most 1 / HOT_SHARE groups
    hot = [r[group] for r in counts.where(F.col("__n") >= max(1000, total * HOT_SHARE)).select(group).collect()]
    if not hot:
        return samples.join(approvals, group)
    is_hot = F.col(group).isin(hot)
    dealt = samples.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(COPIES))).otherwise(F.lit(0)).cast("int"))
    copies = approvals.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [group, "__salt"]).drop("__salt")


def read_fields(labels: DataFrame, keys: tuple, text: str = "text") -> DataFrame:
    """keys, text and values (see fields.field_values): each label is read once, however often the result is used."""
    return kept(fields.field_values(labels, keys, text, by=keys), "label-fields")


def group_pairs(approvals: DataFrame, samples: DataFrame, group: str = "group_id", sample: str = "sample_no", limit: int = BROADCAST_BYTES) -> DataFrame:
    """pair_id (struct of group and sample), atext, stext, avalues, svalues of every sample whose group has an approval.

    approvals: group, text, values from read_fields, one row a group; samples: group, sample, text. A sample without an approval is left out.
    """
    size = approvals.agg(F.sum(F.octet_length("text") * 2 + 1024)).first()[0] or 0
    a = approvals.withColumnsRenamed({"text": "atext", "values": "avalues"})
    s = fields.field_values(samples, (group, sample), by=(group, sample)).withColumnsRenamed({"text": "stext", "values": "svalues"})
    rows = meet(s, a, group, size, sample, limit)
    return kept(rows.select(F.struct(group, sample).alias("pair_id"), "atext", "stext", "avalues", "svalues"), "label-pairs")


def compared_fields(pairs: DataFrame) -> DataFrame:
    """Field rows (see compare.compare_fields) of group_pairs."""
    merged = F.zip_with("avalues", "svalues", lambda a, s: F.struct(a["field"].alias("field"), a["field_ord"].alias("field_ord"), a["value"].alias("approval"), s["value"].alias("sample")))
    return compare.compare_fields(pairs.select("pair_id", F.inline(merged)))


def _listed(*cols: str) -> Column:
    """A pair's rows as an array in the order of cols."""
    return F.array_sort(F.collect_list(F.struct(*cols)))


def sample_results(pairs: DataFrame, logo: DataFrame | None = None, barcode: DataFrame | None = None) -> DataFrame:
    """One row a sample: verdict, score, counts, and its field rows, line rows and token differences as arrays.

    logo and barcode have pair_id and status. Lines are aligned once; all results come together by pair.
    """
    by_field = compare_nested(compared_fields(pairs).where("status <> 'NOT_CHECKED'"), "fields", "field_ord", "field", "approval", "sample", "status", "score")
    lines = kept(compare.compare_lines(pairs), "label-lines")
    by_line = compare_nested(lines, "lines", "line", "approval_line", "sample_line", "approval", "sample", "status")
    diffs = compare.visual_diffs(lines).withColumn("at", F.coalesce("approval_line", "sample_line"))
    diffs = diffs.groupBy("pair_id").agg(_listed("at", "approval_line", "sample_line", "type", "approval_text", "sample_text").alias("differences"))
    summary = compare.summarise(pairs, compare.scored_fields(by_field, len(FIELDS)), compare.scored_lines(by_line), logo, barcode)
    out = summary.join(by_field.select("pair_id", "fields"), "pair_id", "left").join(by_line.select("pair_id", "lines"), "pair_id", "left")
    return out.join(diffs, "pair_id", "left")


def compare_nested(rows: DataFrame, name: str, *cols: str) -> DataFrame:
    """pair_id, the counts by status, and the rows themselves as the array name."""
    return rows.groupBy("pair_id").agg(*compare.counts(F.col("status")), _listed(*cols).alias(name))


def result_records(approvals: DataFrame, results: DataFrame, group: str = "group_id", sample: str = "sample_no", size: int = RECORD_SAMPLES) -> DataFrame:
    """group, text, values of every approval (from read_fields) with page and samples: the results of samples page * size on, in order, as an array.

    A group of up to size samples (numbers from 0) is one record; a larger one has a record for each size of them. A group without
    samples has one record with none.
    """
    rows = results.select(F.col(f"pair_id.{group}").alias(group), F.floor(F.col(f"pair_id.{sample}") / size).cast("long").alias("page"), F.struct(F.col(f"pair_id.{sample}").alias(sample), *[c for c in results.columns if c != "pair_id"]).alias("r"))
    records = rows.groupBy(group, "page").agg(F.array_sort(F.collect_list("r")).alias("samples"))
    out = approvals.join(records, group, "left")
    return out.withColumns({"page": F.coalesce("page", F.lit(0).cast("long")), "samples": F.coalesce("samples", F.array()), "samples_count": F.coalesce(F.size("samples"), F.lit(0))})
