"""Queries of what goes beyond the reference: look-alike labels, sketches, streams with state, stored layout, SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagsmith import fixtures as X
from tagsmith.functions import confusions, sql
from tagsmith.functions.aliases import owners
from tagsmith.operators import fields, sketches
from tagsmith.plans import label_qc
from tagsmith.queries import _COMPARED, _PAIRS, _clean, _label, _line, _lines, _values, query
from tagsmith.queries_lines import ORACLE_SQL
from tagsmith.sources import layout
from tagsmith.sources.shared import kept, shared_folder
from tagsmith.streaming import sessions

_MISREAD = "CASE WHEN (pair_id + line_no) % 3 = 0 THEN concat(translate(substr(line, 1, strpos(line, ':')), 'OISB', '015' || '8'), substr(line, strpos(line, ':') + 1)) ELSE line END"
_CANON = lambda x: f"regexp_replace(translate({_label(x)}, '{''.join(confusions.CONFUSED)}', '{''.join(confusions.CONFUSED.values())}'), '[^A-Z0-9]', '', 'g')"


@query(rf"""WITH {_PAIRS}, ls AS (SELECT pair_id, CAST(line_no AS int) AS line_no, {_MISREAD} AS line FROM (SELECT pair_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT pair_id, {_lines('stext', _line)} AS l FROM pairs)) WHERE strpos(line, ':') > 0),
parts AS (SELECT pair_id, line_no, regexp_extract(line, '^(.*?)\s*[:=|;]', 1) AS said, {_clean("regexp_replace(line, '^.*?[:=|;]', '')")} AS remainder FROM ls),
al(alias, field) AS (VALUES {_values(owners().items())}), keyed AS (SELECT *, {_CANON('alias')} AS key FROM al)
SELECT pair_id, line_no, said, remainder, alias, field, CAST(levenshtein(upper(said), alias) AS int) AS distance FROM (SELECT *, {_CANON('said')} AS key FROM parts WHERE said <> '') JOIN keyed USING (key)
QUALIFY row_number() OVER (PARTITION BY pair_id, line_no ORDER BY levenshtein(upper(said), alias), alias, field) = 1""")
def confusable_aliases(spark, d):
    """Labels of samples, every third with letters as look-alike digits."""
    rows = fields.explode_lines(X.label_pairs(spark, d), "pair_id", "stext").where("instr(line, ':') > 0")
    at = F.instr("line", ":")
    misread = F.concat(F.translate(F.substring("line", F.lit(1), at), "OISB", "0158"), F.substring("line", at + 1, F.length("line")))
    rows = rows.withColumn("line", F.when((F.col("pair_id") + F.col("line_no")) % 3 == 0, misread).otherwise(F.col("line")))
    return confusions.confusable_starts(rows, "pair_id", "line_no")


@query(_COMPARED + "SELECT field, status, count(*) AS n, true AS distinct_near, true AS median_near FROM field_rows WHERE status <> 'NOT_CHECKED' GROUP BY field, status")
def field_sketches(spark, d):
    """Sketches of five days' field rows, merged, beside the exact answers: both within their error bounds."""
    rows = kept(label_qc.field_rows(X.label_pairs(spark, d), every=False).withColumn("day", F.col("pair_id") % 5), "field-rows")
    keys = ("field", "status")
    got = sketches.answers(sketches.merged_sketches(sketches.daily_sketches(rows, keys, "sample", "score"), keys), 0.5)
    exact = rows.groupBy(*keys).agg(F.count_distinct("sample").alias("different"), F.percentile("score", F.lit(0.5 - 0.03)).alias("low"), F.percentile("score", F.lit(0.5 + 0.03)).alias("high"))
    near = F.abs(F.col("distinct") - F.col("different")) <= F.col("different") * 0.07 + 1
    # neighbouring ranks of few rows lie further apart than the bound
    middle = (F.col("q50") >= F.col("low") - 1e-9) & (F.col("q50") <= F.col("high") + 1e-9) | (F.col("n") < 100)
    return got.join(exact, list(keys)).select(*keys, "n", near.alias("distinct_near"), middle.alias("median_near"))


_EVENTS = "event_id bigint, user_id bigint, ts timestamp, cents bigint"


@query("""WITH e AS (SELECT user_id, ts, CAST(round(value * 100) AS bigint) AS cents FROM events), b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n, CAST(sum(cents) AS bigint) AS total FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    """events replayed as a stream: batches that overlap by days, rows out of order, each third row sent twice; then one row that ends all sessions."""
    events = X.table(spark, d, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    # a row comes in the batch of its week or, by its hash, in the next one; repeats in either
    week = F.floor(F.unix_timestamp("ts") / 604800)
    sent = events.withColumn("at", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(week, week + 1)).otherwise(F.array(week + F.pmod(F.xxhash64("event_id"), F.lit(2))))))
    last = events.agg(F.lit(-1).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"), F.lit(0).cast("bigint").alias("cents"))
    sent = sent.unionByName(last.withColumn("at", F.floor(F.unix_timestamp("ts") / 604800)))
    # one file a batch, written in order: the stream takes files by their time
    for (at,) in sorted(sent.select("at").distinct().collect()):
        sent.where(F.col("at") == at).drop("at").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = sessions.event_stream(spark, f"{folder}/in", _EVENTS)
    sessions.write_sessions(stream, "event_id", "user_id", "ts", "cents", "20 days", "6 hours", f"{folder}/out", f"{folder}/state").awaitTermination()
    out = spark.read.parquet(f"{folder}/out").where("user_id is not null")
    return out.select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n", "total")


@query(f"WITH appr AS ({X.APPROVALS_SQL}), samp AS ({X.SAMPLES_SQL}) SELECT group_id, sample_no, s.text AS stext, a.text AS atext FROM samp s JOIN appr a USING (group_id)")
def stored_group_pairs(spark, d):
    """Approvals and samples stored by bucket, then joined without an exchange."""
    folder, name = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}", f"labels_{uuid.uuid4().hex}"
    for kind, rows in (("a", X.approvals(spark, d)), ("s", X.samples(spark, d))):
        layout.store_labels(rows, f"{name}_{kind}", buckets=8, path=f"{folder}/{kind}")
    return layout.stored_pairs(spark, f"{name}_a", f"{name}_s")


@query(ORACLE_SQL["line_align"])
def line_align_sql(spark, d):
    sql.register(spark)
    X.label_pairs(spark, d).createOrReplaceTempView("pairs")
    return spark.sql(sql.LINE_ALIGN)
