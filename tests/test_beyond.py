import datetime

from pyspark.sql import functions as F

from tagsmith.functions import confusions, sql
from tagsmith.functions import text as T
from tagsmith.operators import sketches
from tagsmith.sources import layout
from tagsmith.streaming import sessions


def test_confusable_labels(spark):
    lines = spark.createDataFrame([(1, "5IZE: 4"), (2, "C0L0R = RED"), (3, "BUYER CODE: 7"), (4, "B0X: 1"), (5, "no label"), (6, ": x"), (7, "P0 N0: O0I1"), (8, "6.W: 1")], "k int, line string")
    got = {r["k"]: (r["said"], r["alias"], r["field"], r["distance"], r["remainder"]) for r in confusions.confusable_starts(lines, "k").collect()}
    # the value keeps its letters and digits as they are
    assert got == {1: ("5IZE", "SIZE", "SIZE", 1, "4"), 2: ("C0L0R", "COLOR", "COLOR", 2, "RED"), 3: ("BUYER CODE", "BUYER CODE", "BUYER CODE", 0, "7"), 7: ("P0 N0", "PO NO", "PO NO", 2, "O0I1")}


def test_merged_sketches_equal_the_whole(spark):
    rows = spark.range(20000).select((F.col("id") % 7).alias("day"), F.lit("f").alias("field"), (F.col("id") % 5000).cast("string").alias("value"), F.when(F.col("id") % 4 > 0, F.col("id") % 1000).cast("double").alias("score"))
    daily = sketches.daily_sketches(rows, ("field",), "value", "score")
    merged = sketches.answers(sketches.merged_sketches(daily, ("field",)), 0.1, 0.5).first()
    whole = sketches.answers(sketches.daily_sketches(rows.withColumn("day", F.lit(0)), ("field",), "value", "score"), 0.1, 0.5).first()
    assert daily.count() == 7 and merged["n"] == 20000 and merged["n_scores"] == 15000
    # registers of the distinct count do not depend on the order of the merges; quantiles keep their bound
    assert merged["distinct"] == whole["distinct"] and abs(merged["distinct"] - 5000) < 5000 * 0.05
    for r in (merged, whole):
        assert abs(r["q50"] - 500) < 1000 * 0.03 and abs(r["q10"] - 100) < 1000 * 0.03
    none = sketches.answers(sketches.merged_sketches(sketches.daily_sketches(rows.withColumn("score", F.lit(None).cast("double")), ("field",), "value", "score"), ("field",)), 0.5).first()
    assert none["q50"] is None and none["n_scores"] == 0


def test_stored_labels_meet_without_an_exchange(spark, tmp_path):
    approvals = spark.createDataFrame([(i, f"A{i}") for i in range(20)], "group_id long, text string")
    samples = spark.createDataFrame([(i % 25, i, f"S{i}") for i in range(100)], "group_id long, sample_no long, text string")
    layout.store_labels(approvals, "test_stored_a", buckets=4, path=str(tmp_path / "a"))
    layout.store_labels(samples, "test_stored_s", buckets=4, path=str(tmp_path / "s"))
    pairs = layout.stored_pairs(spark, "test_stored_a", "test_stored_s")
    plan = pairs.groupBy("group_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and pairs.count() == 80
    spark.sql("DROP TABLE test_stored_a")
    spark.sql("DROP TABLE test_stored_s")


TEXTS = [None, "", " a\t b ", "M—N–O−P “q” ‘r’ s|t", "12.50% ABC-1/2 x", "Straße é", "a\r\nb\x0bc\n\n d", "a b", "1 2", "\xa0x　"]


def test_sql_functions_are_the_forms(spark):
    sql.register(spark)
    df = spark.createDataFrame([(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)], "i int, a string, s string")
    df.createOrReplaceTempView("texts_for_sql")
    got = spark.sql("SELECT i, label_norm(a) n, label_key(a) k, label_numbers(a) d, label_lines(a) l, tolerant_equal(a, s) e, numeric_difference(a, s) x FROM texts_for_sql")
    a, s = F.col("a"), F.col("s")
    want = df.select("i", T.compare_form(a).alias("n"), T.key_form(a).alias("k"), T.numbers(a).alias("d"), T.lines(a).alias("l"), T.tolerant_equal(a, s).alias("e"), T.numeric_difference(a, s).alias("x"))
    assert sorted(got.collect()) == sorted(want.collect())
    # no Python in the plan
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT overall_score(4, 0.5, 'PASS', NULL) v").first()["v"] == (0.5 * 0.85 + 0.1) / 0.95
    assert spark.sql("SELECT overall_score(0, 0.5, NULL, 'NOT_FOUND') v").first()["v"] == 0


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_repeated_and_late_events(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, cents long"
    batches = [
        [(1, 7, at(0), 5), (2, 7, at(40), 1), (1, 7, at(0), 5)],
        [(3, 7, at(20), 2), (1, 7, at(0), 5), (4, 8, at(50), 9)],
        [(5, 7, at(400), 3)],
        [(2, 7, at(40), 1), (7, 7, at(3000), 0)],
        # later than the watermark allows: its session is written already
        [(6, 7, at(10), 100)],
        [(8, 7, at(9000), 0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sessions.event_stream(spark, str(tmp_path / "in"), schema)
    sessions.write_sessions(stream, "event_id", "user_id", "ts", "cents", "2 hours", "30 minutes", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r["user_id"], r["begin"], r["end"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(7, at(0), at(70), 3, 8), (8, at(50), at(80), 1, 9), (7, at(400), at(430), 1, 3), (7, at(3000), at(3030), 1, 0)}
    whole = spark.createDataFrame([r for b in batches[:3] for r in b], schema)
    batch = sessions.sessions(sessions.once(whole, "event_id", "ts", "2 hours"), "user_id", "ts", "cents", "30 minutes").collect()
    assert {tuple(r) for r in batch} == {x for x in got if x[1] < at(3000)}
