import json

from pyspark.sql import functions as F

from tagsmith.operators import groups, outcome
from tagsmith.sources import admission, payloads

FILES = "request_id long, role string, position int, name string, length long"


def admitted(spark, rows, limit=100):
    return {(r["request_id"], r["position"]): r["reason"] for r in admission.admit(spark.createDataFrame(rows, FILES), limit).collect()}


def test_first_failing_rule(spark):
    rows = [
        (1, "approval", 0, "a.PNG", 10), (1, "sample", 1, "s.jpg", 10), (1, "sample", 2, "", 0), (1, "approval", 3, "b.png", 5),
        (2, "approval", 0, "a.png", 60), (2, "sample", 1, "s.exe", 50),
        (3, "sample", 0, "s.png", 1), (3, "approval", 1, None, 1),
        (4, "approval", 0, "a.txt", 1), (4, "sample", 1, "s.png", 1), (4, "sample", 2, "s.gif", 1),
        (5, "approval", 0, "a.png", 1), (5, "sample", 1, "", 1),
        (6, "approval", 0, "a.png", 1), (6, "sample", 1, "noending", None), (6, "sample", 2, "t.pdf", 1),
    ]
    got = admitted(spark, rows)
    assert got == {
        (1, 0): None, (1, 1): None, (1, 2): admission.EMPTY, (1, 3): admission.SECOND,
        (2, 0): admission.TOO_LARGE, (2, 1): admission.TOO_LARGE,
        (3, 0): admission.NO_APPROVAL, (3, 1): admission.EMPTY,
        (4, 0): admission.APPROVAL_TYPE, (4, 1): admission.OTHER, (4, 2): admission.SAMPLE_TYPE,
        (5, 0): admission.NO_SAMPLE, (5, 1): admission.EMPTY,
        (6, 0): admission.OTHER, (6, 1): admission.SAMPLE_TYPE, (6, 2): admission.OTHER,
    }
    assert admitted(spark, []) == {}


def test_limit_is_of_all_files_together(spark):
    files = [(1, "approval", 0, "a.png", 50), (1, "sample", 1, "s.png", 50), (2, "approval", 0, "a.png", 50), (2, "sample", 1, "s.png", 51)]
    assert {k for k, v in admitted(spark, files).items() if v} == {(2, 0), (2, 1)}


def test_admitted_labels(spark):
    files = spark.createDataFrame([(7, "approval", 0, "a.png", 1), (7, "sample", 9, "z.png", 1), (7, "sample", 3, "y.png", 1)], FILES)
    approvals, samples = admission.admitted_labels(admission.admit(files))
    assert [tuple(r) for r in approvals.collect()] == [(7, "a.png")]
    assert sorted(tuple(r) for r in samples.collect()) == [(7, 0, "y.png"), (7, 1, "z.png")]


def test_payloads(spark):
    good = {"approval": {"filename": "a", "ocr_text": "é \"q\""}, "samples": [{"filename": "s", "score": 97.5, "status": "PASS", "matched": 1, "mismatched": 0, "missing": 0, "extra": 0, "fields": [{"field": "SIZE", "approval": "4", "sample": "4", "status": "MATCH", "score": 100.0}, {"field": "QTY", "approval": None, "sample": "", "status": "EXTRA", "score": None}]}, {"filename": "t", "fields": []}]}
    bodies = [(1, json.dumps(good)), (2, json.dumps(good)[:-3]), (3, None), (4, " "), (5, "[]"), (6, "{}"), (7, '{"samples": [{"score": "x", "filename": "keep"}]}'), (8, json.dumps(good | {"client": 1, "browser": "b"})), (9, "null"), (10, '{"samples": {}}')]
    parsed = payloads.parse(spark.createDataFrame(bodies, "payload_id long, body string")).cache()
    rows = {r["payload_id"]: r for r in parsed.collect()}
    assert {k: r["error"] for k, r in rows.items()} == {1: None, 2: "not a JSON object", 3: "no payload", 4: "no payload", 5: "not a JSON object", 6: "no samples", 7: "unreadable values", 8: None, 9: "not a JSON object", 10: "unreadable values"}
    assert rows[8]["extras"] == ["browser", "client"] and rows[7]["payload"]["samples"][0]["filename"] == "keep"
    assert {r["payload_id"]: r["body"] for r in payloads.quarantine(parsed).collect()}[2] == bodies[1][1]
    samples, fields = payloads.result_tables(parsed)
    again_samples, again_fields = payloads.result_tables(payloads.parse(payloads.nested(samples, fields)))
    assert sorted(map(repr, samples.collect())) == sorted(map(repr, again_samples.collect())) and samples.count() == 4
    assert sorted(map(repr, fields.collect())) == sorted(map(repr, again_fields.collect())) and fields.count() == 4


def test_outcomes(spark):
    rows = [(1, b"ok", "5", "5", "90", None), (2, None, "5", "5", "90", None), (3, b"\xff\xfe", "5", "5", "90", None), (4, b"x", "wide", "5", "90", None), (5, b"x", "5", None, "90", None), (6, b"x", "5", "-1", "90", None), (7, b"x", "5", "5", "101", None), (8, b"x", "5", "5", None, None), (9, b"\xff", "x", "x", "x", "timed out"), (10, b"x", "5", "5", "NaN", None)]
    df = spark.createDataFrame(rows, "k long, content binary, width string, height string, confidence string, error string")
    labels = df.select("k", outcome.read_label(*[F.col(c) for c in ("content", "width", "height", "confidence", "error")]).alias("label"))
    got = {r["k"]: (r["label"]["error"], r["label"]["value"] and r["label"]["value"]["text"]) for r in labels.collect()}
    assert got == {1: (None, "ok"), 2: ("file is missing", None), 3: ("text is not UTF-8", None), 4: ("width is not a number", None), 5: ("height is missing", None), 6: ("height is not positive", None), 7: ("confidence is out of range", None), 8: (None, "x"), 9: ("engine: timed out", None), 10: ("confidence is not a number", None)}
    good, bad = outcome.split(labels, "label")
    assert good.count() == 2 and bad.count() == 8
    pairs = outcome.pair_outcomes(labels.where("k in (1, 2)").withColumnRenamed("k", "pair_id"), labels.where("k in (1, 2, 8)").withColumnRenamed("k", "pair_id"))
    assert {r["pair_id"]: r["pair"]["error"] for r in pairs.collect()} == {1: None, 2: "approval: file is missing", 8: "approval: file is missing"}


def test_contained_checks(spark):
    df = spark.createDataFrame([(1, "PASS", False), (2, None, True)], "pair_id long, s string, bad boolean")
    got = outcome.checks(df.select("pair_id", outcome.outcome(F.col("s"), (F.col("bad"), "no decoder")).alias("check"))).collect()
    assert sorted(map(tuple, got)) == [(1, "PASS", None), (2, "NOT_CHECKED", "no decoder")]
    text = spark.range(1).select(outcome.then(outcome.outcome(F.lit("7")), lambda v: outcome.whole_number(v, "n")).alias("o")).first()["o"]
    assert text["value"] == 7 and text["error"] is None


APPROVALS = [(1, "BUYER: A\nSIZE: 4"), (2, "BUYER: B"), (3, "SIZE: 9"), (4, None)]
SAMPLES = [(1, 0, "BUYER: A\nSIZE: 4"), (1, 1, "BUYER: A\nSIZE: 5"), (1, 2, "BUYER: A"), (2, 0, "buyer: b"), (4, 0, ""), (9, 0, "SIZE: 1"), *[(3, i, f"SIZE: {9 if i % 2 else i}") for i in range(1200)]]


def records(spark, limit):
    approvals = groups.read_fields(spark.createDataFrame(APPROVALS, "group_id long, text string"), ("group_id",))
    samples = spark.createDataFrame(SAMPLES, "group_id long, sample_no long, text string")
    results = groups.sample_results(groups.group_pairs(approvals, samples, limit=limit))
    return groups.result_records(approvals, results)


def test_groups_of_none_one_and_many(spark):
    out = records(spark, groups.BROADCAST_BYTES)
    rows = out.collect()
    got = {(r["group_id"], r["page"]): r for r in rows}
    assert [s["sample_no"] for s in got[1, 0]["samples"]] == [0, 1, 2] and [s["status"] for s in got[1, 0]["samples"]] == ["PASS", "FAIL", "FAIL"]
    second = got[1, 0]["samples"][1]
    assert [(f["field"], f["status"]) for f in second["fields"]] == [("BUYER", "MATCH"), ("SIZE", "MISMATCH")]
    assert [(d["type"], d["approval_text"], d["sample_text"]) for d in second["differences"]] == [("replace", "4", "5")]
    assert got[1, 0]["samples"][2]["missing"] == 1 and [x["status"] for x in got[1, 0]["samples"][2]["lines"]] == ["MATCH", "MISSING"]
    assert got[2, 0]["samples_count"] == 1 and got[2, 0]["samples"][0]["status"] == "PASS"
    # empty labels on both sides: nothing to compare
    assert got[4, 0]["samples"][0]["total"] == 0 and got[4, 0]["samples"][0]["status"] == "FAIL"
    # a large group is many records of bounded size; a sample without an approval has none
    assert len([k for k in got if k[0] == 3]) == 12 and all(len(r["samples"]) <= groups.RECORD_SAMPLES for r in rows) and not any(k[0] == 9 for k in got)
    assert sum(s["status"] == "PASS" for r in rows if r["group_id"] == 3 for s in r["samples"]) == 600
    # a group without samples has a record with none, and the approval's fields are in every record
    lone = groups.read_fields(spark.createDataFrame([(1, "SIZE: 4"), (8, "x")], "group_id long, text string"), ("group_id",))
    results = groups.sample_results(groups.group_pairs(lone, spark.createDataFrame([(1, 0, "SIZE: 4")], "group_id long, sample_no long, text string")))
    rows = {r["group_id"]: r for r in groups.result_records(lone, results).collect()}
    assert (rows[8]["page"], rows[8]["samples_count"], rows[8]["samples"]) == (0, 0, []) and rows[1]["samples_count"] == 1
    assert {v["field"]: v["value"] for v in rows[1]["values"]}["SIZE"] == "4"


def test_shuffled_and_dealt_approvals_give_the_same(spark):
    key = lambda r: (r["group_id"], r["page"])
    assert sorted(records(spark, 0).collect(), key=key) == sorted(records(spark, groups.BROADCAST_BYTES).collect(), key=key)


def test_approvals_are_read_once(spark, tmp_path, monkeypatch):
    a, s = str(tmp_path / "a"), str(tmp_path / "s")
    spark.createDataFrame(APPROVALS[:3], "group_id long, text string").write.parquet(a)
    spark.createDataFrame(SAMPLES[:4], "group_id long, sample_no long, text string").write.parquet(s)
    plans, kept = [], groups.kept
    monkeypatch.setattr(groups, "kept", lambda rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or kept(rows, name))
    approvals = groups.read_fields(spark.read.parquet(a), ("group_id",))
    records = groups.result_records(approvals, groups.sample_results(groups.group_pairs(approvals, spark.read.parquet(s))))
    assert records.count() == 3
    plans.append(records._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    # the texts are read and their fields looked for in one place; what is written there serves pairs and records
    assert sum(f"[file:{a}" in p for p in plans) == 1 and sum("Window" in p for p in plans) == 2 and plans[0].count("FileScan") == 1
