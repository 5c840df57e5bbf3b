import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from tagsmith.sources import files, sinks
from tagsmith.streaming import arrivals

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_a_verdict_for_every_pair(spark):
    got = entry.entry(spark)
    assert got.columns[:3] == ["pair_id", "score_percent", "result"]


def test_queries_and_sql_agree_in_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    code = "import sys; sys.modules['tagsmith.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; n = e.queries(); assert n and not any(x.startswith('op') for x in n) and 'pipeline' not in n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_files(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "c.pdf", "d.jpg"):
        (tmp_path / name).write_bytes(b"" if name == "d.jpg" else b"x")
    got = {r["path"].rsplit("/", 1)[1] for r in files.read_labels(spark, str(tmp_path)).select("path").collect()}
    assert got == {"a.PNG", "c.pdf"}


def test_stream_of_samples(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "SIZE: 4"), (2, 1, "SIZE: 5")], "pair_id long, group_id long, stext string").write.parquet(src)
    approvals = spark.createDataFrame([(1, "SIZE: 4")], "group_id long, atext string")
    arrivals.check_arrivals(arrivals.sample_stream(spark, src), approvals, out, str(tmp_path / "c")).awaitTermination()
    assert {r["pair_id"]: r["status"] for r in spark.read.parquet(out).collect()} == {1: "PASS", 2: "FAIL"}


def test_json_sink(spark):
    summary = spark.createDataFrame([(1, "PASS")], "pair_id long, status string")
    rows = spark.createDataFrame([(1, 0, "SIZE", "4", "4", "MATCH", 100.0)], "pair_id long, field_ord int, field string, approval string, sample string, status string, score double")
    assert '"fields":[{"field":"SIZE"' in sinks.results_json(summary, rows).first()["json"]
