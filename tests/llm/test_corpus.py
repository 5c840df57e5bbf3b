import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagsmith.llm import decontamination as D
from tagsmith.llm import toxicity as T
from tagsmith.llm import url_filters as U
from tagsmith.llm.queries import ORACLE_SQL, QUERIES

SYLLABLES = ["an", "the", "er", "on", "ing", "ti", "re", "ou", "st", "ha", "wh", "ble", "ed", "nd", "ly", "es"]


def prose(rnd, n):
    return " ".join("".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = prose(rnd, rnd.randint(30, 90)).split()
        toxic = rnd.random() < 0.25
        for _ in range(4 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["grobnik", "vulzart", "snarfel", "plodgit"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    items = [(0, "Maria has 12 apples and 5 pears in her red basket. If Maria gives away 5 pears, how many apples does she still hold today?"), (1, prose(rnd, 40)), (2, None), (3, "two plus two")]
    rows += [(600, prose(rnd, 20) + " Thomas has 47 apples and 9 pears in her red basket. If Thomas gives away 9 pears, how many apples does she still hold today? " + prose(rnd, 20), "en", "s", 1)]
    rows += [(601, prose(rnd, 20) + " Thomas has 47 apples and 9 pears in her red basket. If Peter gives away 8 pears, how many apples does she still hold today? " + prose(rnd, 20), "en", "s", 1)]
    rows += [(602, prose(rnd, 30) + " " + items[1][1] + " " + prose(rnd, 9), "en", "s", 1), (603, rows[3][1], "en", "s", 1), (604, rows[4][1] + " end", "en", "s", 1), (605, None, "en", "s", 1), (606, "", "en", "s", 1), (607, "two plus two", "en", "s", 1)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_toxicity_on_held_out_rows(spark, corpus):
    got = QUERIES["op10_compression_toxicity"](spark, corpus).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{corpus}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got["held_out"].items())
    held = got[got["held_out"] & got.index.isin(labels.index)]
    assert (held["predicted"] == labels[held.index]).mean() > 0.93
    assert got["score"].between(0, 1).all() and len(got) == 608
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


def test_toxicity_without_labels_or_rows(spark, hard_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.model_for(hard_docs, none)
    assert {r[0] for r in T.with_score(hard_docs, model, score_col="__s").select("__s").collect()} == {0.0}
    assert T.with_score(hard_docs.limit(0), model, score_col="__s").count() == 0


def brute_windows(text, k=5):
    texts = pa.array([text])
    return {int(w) for _, n, _, ws, _ in D.template_windows(texts, k) for w in ws} if text else set()


def test_templates():
    kinds = lambda t: D.template_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    assert kinds("Tom has 3.5 kg and Ann twenty. Then SHE left") == [0, 0, 1, 3, 0, 2, 1, 0, 0, 0]
    assert brute_windows("so Ann bought 12 red hats for Bob today") == brute_windows("so Eve bought 7 red hats for Max today")


def test_decontamination_finds_reparameterised_items(spark, corpus):
    docs, items = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs, items).collect()}
    # 601 fills one slot value of the item with two different ones; 607 is a whole short item
    assert set(got) == {(600, 0), (602, 1), (607, 3)}
    assert got[600, 0]["changed_slots"] > 0 == got[602, 1]["changed_slots"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in items.where("item_id < 2").collect():
        mine = brute_windows(i["text"])
        near = {d for d, t in texts.items() if mine and len(mine & brute_windows(t)) >= 0.8 * len(mine)}
        assert {d for d, j in got if j == i["item_id"]} == near - {601}


def test_decontamination_finds_bare_and_short_items(spark):
    rnd = random.Random(12)
    table, names = "12 + 7 = 19 ; 3 x 14 = 42 ; 81 / 9 = 9 ; 6 + 6 = 12", "of Maria Lopez Tom Baker Ann Fisher Bob Turner Eve Walker"
    items = spark.createDataFrame([(1, table), (2, names), (3, "seven times six"), (4, "the blue whale"), (5, "add 4 apples")], "item_id long, text string")
    around = lambda t: prose(rnd, 30) + " " + t + " " + prose(rnd, 30)
    docs = [(1, around(table)), (2, around(names)), (3, around("seven times six")), (4, around("the blue whale")), (5, around("add 4 apples")), (6, around(table.replace("1", "5"))), (7, around("seven times five")), (8, around("add 5 apples")), (9, "seven times five"), (10, prose(rnd, 60)), (11, table), (12, around("of Maria Lopez and Tom"))]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    # 8 has another value in two literals, 9 is the whole template of 3
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (8, 5), (9, 3), (11, 1)}


def test_decontamination_handles_hard_rows(spark, hard_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "12 12 12 12 12 12"), (None, "one two")], "item_id long, text string")
    assert D.contaminated(hard_docs, items).count() == 0
    assert D.contaminated(hard_docs, items.limit(0)).count() == 0
    assert D.contaminated(hard_docs.limit(0), items).count() == 0


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, corpus).collect()}
    clean = {i for i, t in labels.items() if not t}
    assert len(clean - packed) <= 0.03 * len(clean) and len(packed & {i for i, t in labels.items() if t}) <= 0.15 * (600 - len(clean))
    # 603 copies 3, 604 nearly copies 4, 606 is empty like 605, and 600, 602 and 607 hold benchmark items
    assert not packed & {600, 602, 603, 606, 607} and {601, 605} <= packed and not {4, 604} <= packed
    stage = corpus_pipeline.decontaminate(spark, docs, corpus)
    assert stage.columns == docs.columns and stage.count() == docs.count() - 3


def test_url_filter_intervals(spark):
    entries = [("host", "a.b.org", "block", "2024-02-01"), ("host", "a.b.org", "remove", "2024-03-01"), ("domain", "b.org", "block", "2024-02-10"), ("prefix", "a.b.org/ok", "allow", "2024-01-01"), ("url", "http://a.b.org/ok/x", "block", "2024-02-20"), ("host", None, "block", "2024-01-01"), ("domain", "b.org", "block", "2024-02-10")]
    e = spark.createDataFrame(entries, "kind string, value string, action string, effective string")
    caps = [(1, "http://a.b.org/", "2024-01-31"), (2, "http://A.b.org:80/", "2024-02-01"), (3, "https://a.b.org/p", "2024-03-01"), (4, "http://a.b.org/ok/y?q#f", "2024-02-15"), (5, "http://a.b.org/ok/x", "2024-02-20"), (6, None, "2024-02-20"), (7, "nonsense", "2024-02-20"), (2, "http://A.b.org:80/", "2024-02-01"), (8, "http://a.b.org/", None)]
    c = spark.createDataFrame([(*r, "z") for r in caps], "page_id long, url string, fetched string, kind string")
    got = sorted((r["page_id"], r["decision"], r["kind"]) for r in U.evaluate(c, e).collect() if r["page_id"] != 8)
    assert got == [(1, "none", None), (2, "block", "host"), (2, "block", "host"), (3, "block", "domain"), (4, "allow", "prefix"), (5, "block", "url"), (6, "none", None), (7, "none", None)]
    assert U.evaluate(c, e.limit(0)).where("decision <> 'none'").count() == 0 and U.evaluate(c.limit(0), e).count() == 0


def test_url_filter_keys_of_any_depth(spark):
    e = spark.createDataFrame([("prefix", "h.org/1/2/3/4/5/6/7", "block", "2024-01-01"), ("domain", "b.c.d.e.f.g.org", "block", "2024-01-01")], "kind string, value string, action string, effective string")
    c = spark.createDataFrame([(1, "http://h.org/1/2/3/4/5/6/7/8", "2024-02-01"), (2, "http://h.org/1/2/3/4/5/6", "2024-02-01"), (3, "http://a.b.c.d.e.f.g.org/", "2024-02-01"), (4, "http://h.org", "2024-02-01")], "page_id long, url string, fetched string")
    assert sorted((r["page_id"], r["decision"], r["kind"]) for r in U.evaluate(c, e).collect()) == [(1, "block", "prefix"), (2, "none", None), (3, "block", "domain"), (4, "none", None)]


def test_registered_sql_covers_registered_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_heavy_keys_join(spark):
    from tagsmith.llm.common import attach

    left = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.min("id").alias("first"), F.count("id").alias("n"))
    got = attach(left, right, ["k"], "n", 2000).collect()
    assert len(got) == 2000 and all(r["first"] == r["k"] if r["k"] else r["first"] == 0 for r in got)


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    rnd = random.Random(31)
    item, near = prose(rnd, 40), prose(rnd, 120)
    rows = [(1, "same text"), (8, "same text"), (8, "a unique text"), (2, "twice"), (2, "twice"), (None, "same text"), (None, None), (9, ""), (None, near + " end"), (3, near), (3, prose(rnd, 50)), (4, "x " + item), (4, "clean words")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id long, row long")
    seen = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = lambda *gone: sorted([r for i, r in enumerate(rows) if i not in gone], key=str)
    # 1, 5: copies of the first row; 4 repeats 3; 6 is empty like 7, which has an id; 8 nearly copies 9; 11 holds the item
    assert seen(corpus_pipeline.dedup(spark, docs, "")) == want(1, 4, 5, 6)
    kept = corpus_pipeline.dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert seen(corpus_pipeline.near_dedup(spark, kept, "")) == want(1, 4, 5, 6, 8)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert seen(corpus_pipeline.decontaminate(spark, docs, str(tmp_path))) == want(11)
