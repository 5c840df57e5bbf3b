import pytest
from pyspark.sql import functions as F

from tagsmith.operators import ocr, ocr_plan as plan

TOKENS = "label_id long, engine string, variant_ord int, psm_ord int, seq int, text string, confidence string, x string, y string, w string, h string, block_num int, par_num int, line_num int"
CALLS = "label_id long, engine string, variant_ord int, psm_ord int, available boolean, error string"


def token(label, engine, v, p, seq, text, confidence="90", x=0, y=0, w=10, h=20, line=(0, 0, 0)):
    return (label, engine, v, p, seq, text, confidence, str(x), str(y), str(w), str(h), *line)


def run(spark, tokens, calls, settings=None, images=((1, 100, 100, 100, 100),)):
    images = spark.createDataFrame(list(images), "label_id long, image_w int, image_h int, ocr_w int, ocr_h int")
    labels, words = plan.read_labels_by_plan(images, spark.createDataFrame(calls, CALLS), spark.createDataFrame(tokens, TOKENS), settings)
    return {r["label_id"]: r for r in labels.collect()}, sorted((r["label_id"], r["line_index"], r["word_index"], r["text"], r["x"], r["y"], r["w"], r["h"]) for r in words.collect())


def test_settings():
    assert plan.OcrSettings().calls() == [("tesseract", v, 0, 6) for v in range(4)]
    assert plan.OcrSettings(psm=11, second=True).calls()[:3] == [("tesseract", 0, 0, 11), ("tesseract", 0, 1, 6), ("tesseract", 1, 0, 11)] and plan.OcrSettings(psm=11, second=True).calls()[-1] == ("easyocr", 0, 0, None)
    assert {c[0] for c in plan.OcrSettings(psm=11, hosted=True).calls()} == {"easyocr"} and len(plan.OcrSettings(hosted=True).calls()) == 4
    for bad in ({"psm": -1}, {"floor": 101.0}):
        with pytest.raises(ValueError):
            plan.OcrSettings(**bad)


def test_planned_calls(spark):
    got = plan.planned_calls(spark.range(2).withColumnRenamed("id", "label_id"), plan.OcrSettings(psm=4)).collect()
    assert len(got) == 16 and (got[1]["psm_ord"], got[1]["psm"], got[1]["variant"]) == (1, 6, "original")


def test_winner_by_score_and_order(spark):
    settings = plan.OcrSettings(psm=11, second=True)
    calls = [(1, "tesseract", v, p, True, None) for v in range(4) for p in range(2)] + [(1, "easyocr", 0, 0, True, None)]
    tokens = [token(1, "tesseract", 2, 1, 0, "late"), token(1, "tesseract", 1, 1, 0, "same"), token(1, "tesseract", 1, 0, 0, "seem"), token(1, "tesseract", 0, 0, 0, "low", "50"), token(1, "tesseract", 3, 0, 0, "  ", "99"), token(1, "easyocr", 0, 0, 0, "better", "0.99")]
    labels, words = run(spark, tokens, calls, settings)
    # equal scores: the first variant, then the first page mode; the second engine only lends its confidence
    assert (labels[1]["engine"], labels[1]["variant_ord"], labels[1]["psm_ord"], labels[1]["text"], labels[1]["confidence"]) == ("tesseract", 1, 0, "seem", 94.5)
    assert words == [(1, 0, 0, "seem", 0, 0, 10, 20)]


def test_calls_that_are_away_do_not_win(spark):
    calls = [(1, "tesseract", 0, 0, False, "timed out"), (1, "tesseract", 1, 0, True, None), (2, "tesseract", 1, 0, False, None), (2, "tesseract", 0, 0, False, "no engine")]
    tokens = [token(1, "tesseract", 0, 0, 0, "ghost", "99"), token(1, "tesseract", 1, 0, 0, "real", "20"), token(2, "tesseract", 0, 0, 0, "ghost"), token(1, "tesseract", 7, 0, 0, "unplanned", "100")]
    labels, words = run(spark, tokens, calls, images=[(1, 100, 100, 100, 100), (2, 100, 100, 100, 100), (3, 9, 9, 9, 9)])
    assert labels[1]["text"] == "real" and labels[1]["error"] is None
    assert (labels[2]["text"], labels[2]["engine"], labels[2]["confidence"], labels[2]["error"], labels[2]["n_words"]) == ("", "easyocr", 0.0, "no engine", 0)
    # a label without calls still has a row
    assert labels[3]["text"] == "" and labels[3]["error"] is None and len(words) == 1


def test_second_engine_has_lines_by_height(spark):
    settings = plan.OcrSettings(hosted=True)
    calls = [(1, "easyocr", v, 0, v != 0, None) for v in range(4)]
    tokens = [token(1, "easyocr", 1, 0, 0, "b", "0.5", 30, 2), token(1, "easyocr", 1, 0, 1, "a", "0.5", 0, 0), token(1, "easyocr", 1, 0, 2, "c", "0.5", 0, 50), token(1, "easyocr", 1, 0, 3, "faint", "0.2", 60, 0), token(1, "easyocr", 2, 0, 0, "better", "0.9")]
    labels, words = run(spark, tokens, calls, settings)
    assert labels[1]["text"] == "a b\nc" and labels[1]["variant_ord"] == 1 and labels[1]["n_lines"] == 2
    assert [w[1:4] for w in words] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]


def test_boxes_are_moved_into_the_image(spark):
    words = spark.createDataFrame([(1, -5, 0, 20, 10), (2, 95, 95, 20, 20), (3, 300, 0, 10, 10), (4, 0, 0, 0, 5)], "seq int, x int, y int, w int, h int")
    got = {r["seq"]: (r["ox"], r["oy"], r["ow"], r["oh"], r["x2"], r["y2"]) for r in ocr.map_boxes(words, F.lit(100), F.lit(100), F.lit(100), F.lit(100)).collect()}
    assert got == {1: (0, 0, 20, 10, 20, 10), 2: (95, 95, 5, 5, 100, 100), 3: (99, 0, 1, 10, 100, 10)}


def test_only_winners_are_shuffled(spark):
    tokens = [token(i, "tesseract", v, 0, n, f"w{n}", str(50 + (i + v) % 4), 10 * n) for i in range(30) for v in range(4) for n in range(5)]
    images = [(i, 100, 100, 100, 100) for i in range(30)]
    frames = (spark.createDataFrame(images, "label_id long, image_w int, image_h int, ocr_w int, ocr_h int"), spark.createDataFrame([(i, "tesseract", v, 0, True, None) for i in range(30) for v in range(4)], CALLS), spark.createDataFrame(tokens, TOKENS))
    labels, words = plan.read_labels_by_plan(*frames)
    # words meet their winners where they are read
    text = words._jdf.queryExecution().executedPlan().toString()
    met = [line for line in text.splitlines() if "Join" in line and "variant_ord" in line]
    assert met and all("BroadcastHashJoin" in line for line in met)
    shuffled = plan.read_labels_by_plan(*frames, limit=0)
    assert sorted(words.collect()) == sorted(shuffled[1].collect()) and words.count() == 150
    assert sorted(map(repr, labels.collect())) == sorted(map(repr, shuffled[0].collect()))
