import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsmith.functions import align
from tagsmith.operators import barcode, compare, fields, highlight, logo, ocr, report
from tagsmith.plans import label_qc
from tagsmith.queries import QUERIES


def extract(spark, text):
    got = fields.extract_fields(spark.createDataFrame([(1, text)], "label_id long, text string")).collect()
    return {r["field"]: r["value"] for r in got if r["value"]}


def test_fields(spark):
    got = extract(spark, "junk\nBUYER: ABC FASHION LTD.\nDESCRIPTION =\nMEN'S T-SHIRT\n*\nTHIS SIDE UP\nSTYLE-NO: X\nMADE IN CHINA\nPO NO 77\nPO NO:\n")
    assert got["BUYER"] == "ABC FASHION LTD." and got["DESCRIPTION"] == "MEN'S T-SHIRT THIS SIDE UP"
    assert got["COUNTRY OF ORIGIN"] == "CHINA" and got["PO NO"] == "77" and got["STYLE NO"] == "NO: X"


@pytest.mark.parametrize("text,field,value", [("BUYER CODE: 9", "BUYER", "CODE: 9"), ("TOTAL PCS: 5", "TOTAL QTY", "5"), ("POLO SHIRT", "PORT OF LOADING", "O SHIRT"), ("BUYER:\nVENDOR: X", "VENDOR", "X"), ("", "BUYER", None)])
def test_kept_quirks(spark, text, field, value):
    assert extract(spark, text).get(field) == value


def test_value_statuses(spark):
    rows = [("a", "", ""), ("b", "x", ""), ("c", "", "y"), ("d", "AB-1", "ab1"), ("e", "QTY 1.5", "QTY 15"), ("f", "12 PCS", "13 PCS"), ("g", "A" * 60, "A" * 59 + "B"), ("h", "--", "**"), ("i", None, "z")]
    df = spark.createDataFrame([(1, f, 0, a, s) for f, a, s in rows], "pair_id long, field string, field_ord int, approval string, sample string")
    got = {r["field"]: (r["status"], r["score"]) for r in compare.compare_fields(df).collect()}
    assert got["a"] == ("NOT_CHECKED", None) and got["b"] == ("MISSING", 0.0) and got["c"] == ("EXTRA", 0.0) == got["i"]
    assert got["d"] == ("MATCH", 100.0) or got["d"][0] == "MATCH"
    assert got["e"][0] == got["f"][0] == "MISMATCH" and got["g"] == ("MATCH", 98.33) and got["h"] == ("MATCH", 100.0)


def lines_by_hand(a, s):
    out = []
    key = lambda x: "".join(c for c in x if c.isascii() and c.isalnum())
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, s, autojunk=False).get_opcodes():
        for k in range(max(i2 - i1, j2 - j1)):
            ai, sj = (i1 + k if i1 + k < i2 else None), (j1 + k if j1 + k < j2 else None)
            x, y = a[ai] if ai is not None else "", s[sj] if sj is not None else ""
            status = "MATCH" if tag == "equal" else "MISSING" if sj is None else "EXTRA" if ai is None else "MATCH" if key(x) and key(x) == key(y) else "MISMATCH"
            out.append((ai, sj, x, y, status))
    return sorted(out, key=str)


def test_lines_equal_the_standard_alignment(spark):
    rnd = random.Random(4)
    pool = ["AA 1", "BB-2", "BB2", "CC", "DD", "EE 5", "*"]
    pairs = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 7))), "\n".join(rnd.choices(pool, k=rnd.randint(0, 7)))) for i in range(80)]
    df = spark.createDataFrame(pairs, "pair_id long, atext string, stext string")
    rows = compare.compare_lines(df)
    got: dict = {i: [] for i, *_ in pairs}
    for r in rows.collect():
        got[r["pair_id"]].append((r["approval_line"], r["sample_line"], r["approval"], r["sample"], r["status"]))
    for i, a, s in pairs:
        assert sorted(got[i], key=str) == lines_by_hand([x for x in a.split("\n") if x], [x for x in s.split("\n") if x])
    diffs = compare.visual_diffs(rows)
    assert diffs.where("type = 'delete' and approval_line is null").count() == 0


def test_similarity_is_directed(spark):
    df = spark.createDataFrame([("TIDE", "DIET"), ("DIET", "TIDE"), ("", ""), ("x", ""), (None, None)], "a string, b string")
    assert [round(r[0], 2) for r in df.select(align.similarity(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, 1.0, 0.0, 1.0]


def test_summary_table(spark):
    pairs = spark.createDataFrame([(i,) for i in range(5)], "pair_id long")
    f = spark.createDataFrame([(0, 3, 0, 0, 0, 19, 3, 1.0), (1, 3, 1, 0, 0, 18, 4, 0.75), (2, 0, 0, 0, 0, 22, 0, 0.0), (3, 2, 0, 0, 0, 20, 2, 1.0), (4, 0, 0, 0, 0, 22, 0, 0.0)], "pair_id long, matched long, mismatched long, missing long, extra long, not_checked long, total long, field_score double")
    t = spark.createDataFrame([(0, 3, 0, 0, 0, 3, 1.0), (1, 3, 1, 0, 0, 4, 0.75), (2, 4, 0, 0, 0, 4, 1.0), (3, 2, 0, 0, 1, 3, 0.6667)], "pair_id long, matched long, mismatched long, missing long, extra long, total long, score double")
    logo_ = spark.createDataFrame([(0, "PASS"), (2, "FAIL"), (4, "PASS")], "pair_id long, status string")
    got = {r["pair_id"]: r for r in compare.summarise(pairs, f, t, logo_).collect()}
    assert got[0]["status"] == "PASS" and got[0]["score"] == 100.0
    assert got[1]["status"] == "FAIL" and got[1]["score"] == 75.0
    assert got[2]["status"] == "FAIL" and got[2]["matched"] == 4 and got[2]["line_extra"] == 0
    assert got[3]["status"] == "FAIL" and got[3]["line_extra"] == 1
    assert got[4]["status"] == "PASS" and got[4]["total"] == 0


def test_barcode_branches(spark):
    states = ["ERROR", "NOT_CHECKED", "NOT_FOUND", "DETECTED_NOT_DECODED", "DETECTED"]
    cases = [(a, "A" if a == "DETECTED" else "", s, v if s == "DETECTED" else "") for a, s, v in itertools.product(states, states, "AB")]
    side = lambda k: spark.createDataFrame([(i, c[k], c[k + 1]) for i, c in enumerate(cases)], "label_id long, status string, value string")
    got = {r["label_id"]: r["status"] for r in barcode.compare(side(0), side(2)).collect()}
    for i, (a, av, s, sv) in enumerate(cases):
        if {a, s} & {"ERROR", "NOT_CHECKED"}:
            want = "NOT_CHECKED"
        elif a == s == "NOT_FOUND":
            want = "NOT_FOUND"
        elif "NOT_FOUND" in (a, s):
            want = "FAIL"
        elif not av and not sv:
            want = "DETECTED_NOT_DECODED"
        else:
            want = "NOT_CHECKED" if not av or not sv else "PASS" if av == sv else "FAIL"
        assert got[i] == want, cases[i]


def cluster_by_hand(words):
    groups = []
    for y, x, seq, h, text in sorted(words):
        cy = y + h / 2
        for g in groups:
            if abs(cy - g["s"] / len(g["i"])) <= max(8.0, g["h"] / len(g["i"]) * 0.65):
                g["i"].append((x, seq, text, y)), g.update(s=g["s"] + cy, h=g["h"] + h)
                break
        else:
            groups.append({"i": [(x, seq, text, y)], "s": cy, "h": h})
    groups.sort(key=lambda g: min(i[3] for i in g["i"]))
    return [" ".join(t for *_, t in sorted(i[:3] for i in g["i"])) for g in groups]


def test_line_clusters(spark):
    rnd = random.Random(6)
    words = {k: [(rnd.randint(0, 60), rnd.randint(0, 90), s, rnd.choice((8, 12, 30)), f"t{s}") for s in range(rnd.randint(1, 15))] for k in range(25)}
    df = spark.createDataFrame([(k, *w) for k, ws in words.items() for w in ws], "label_id int, y int, x int, seq int, h int, text string")
    got: dict = {}
    for r in ocr.cluster_lines(df).orderBy("label_id", "line_index").collect():
        got.setdefault(r["label_id"], []).append(r["text"])
    assert got == {k: cluster_by_hand(ws) for k, ws in words.items()}


def test_line_clusters_of_long_labels(spark, tmp_path):
    docs = [(1, " ".join(f"w{i}" for i in range(3000))), (2, "a b"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got: dict = {}
    for r in QUERIES["y_cluster_lines"](spark, str(tmp_path)).orderBy("label_id", "line_index").collect():
        got.setdefault(r["label_id"], []).append(r["text"])
    boxes = lambda t: [((i // 7) * 40 + i % 3, (i % 7) * 60, i, 20, w) for i, w in enumerate(t.split())]
    assert got == {k: cluster_by_hand(boxes(t)) for k, t in docs if t}
    # islands with and without overlap, negative heights, tall words
    rnd = random.Random(7)
    words = {k: [(rnd.randint(0, 900), rnd.randint(0, 90), s, rnd.choice((-4, 0, 8, 12, 90)), f"t{s}") for s in range(60)] for k in range(20)}
    df = spark.createDataFrame([(k, *w) for k, ws in words.items() for w in ws], "label_id int, y int, x int, seq int, h int, text string")
    got = {}
    for r in ocr.cluster_lines(df).orderBy("label_id", "line_index").collect():
        got.setdefault(r["label_id"], []).append(r["text"])
    assert got == {k: cluster_by_hand(ws) for k, ws in words.items()}


def test_logo_of_itself_and_of_a_flat_image(spark):
    pix = spark.createDataFrame([(i, y, x, 128 if i == 2 else (x * 37 + y * 11) % 256, 0 if i == 2 else (x + y) % 2) for i in (1, 2) for y in range(8) for x in range(8)], "image_id int, y int, x int, v int, edge int")
    pairs = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 1, 9)], "pair_id int, a_id int, b_id int")
    got = {r["pair_id"]: (r["status"], r["score"]) for r in logo.compare(pairs, pix, pix).collect()}
    assert got == {1: ("PASS", 100.0), 2: ("FAIL", 0.0), 3: ("NOT_FOUND", 0.0), 4: ("NOT_FOUND", 0.0)} or got[2][0] == "FAIL" and got[1] == ("PASS", 100.0)


def regions_by_hand(a, b, gh, gw):
    """status, score, regions of two images {(y, x): (v, edge)} or None, by the reference's rule."""

    def crops(img):
        h, w = (max(p[k] for p in img) + 1 for k in (0, 1)) if img else (0, 0)
        if min(h, w) < 20:
            return None
        return [{(y - int(h * p), x - int(w * r)): img[y, x] for y in range(int(h * p), int(h * q)) for x in range(int(w * r), int(w * s))} for p, q, r, s in logo.REGIONS]

    def ok(c):
        return np.std([v for v, _ in c.values()]) >= 8 and np.mean([e for _, e in c.values()]) >= 0.015

    def grid(c):
        h, w = (max(p[k] for p in c) + 1 for k in (0, 1))
        over = lambda n, s: [[(i, min((g + 1) * s, (i + 1) * n) - max(g * s, i * n)) for i in range(s) if min((g + 1) * s, (i + 1) * n) > max(g * s, i * n)] for g in range(n)]
        cells = [[(c[y, x], p * q) for y, p in ys for x, q in xs] for ys in over(gh, h) for xs in over(gw, w)]
        return np.array([(2 * sum(v * k for (v, _), k in u) + h * w) // (2 * h * w) for u in cells]), np.array([max(e for (_, e), _ in u) for u in cells])

    def score(c, d):
        (v, e), (u, f) = grid(c), grid(d)
        hist = [np.bincount(t // 4, minlength=64) for t in (v, u)]
        r = np.corrcoef(*hist)[0, 1] if hist[0].std() and hist[1].std() else 0.0
        return 0.2 * (1 - np.abs(v - u).mean() / 255) + 0.2 * (r + 1) / 2 + 0.6 * ((e & f).sum() / max(1, (e | f).sum()))

    a, b = crops(a), crops(b)
    if a is None or b is None or not any(map(ok, a)):
        return "NOT_FOUND", 0.0, None
    if not any(map(ok, b)):
        return "FAIL", 0.0, None
    top, at = max((score(c, d), (-i, -j)) for i, c in enumerate(a) for j, d in enumerate(b) if ok(c) and ok(d))
    return "PASS" if top >= 0.72 else "FAIL", round(top * 100, 1), (-at[0], -at[1])


def test_logo_regions(spark):
    rnd = random.Random(11)
    mark = {(y, x): (rnd.randrange(256), int(rnd.random() < 0.3)) for y in range(12) for x in range(22)}
    blank = lambda h, w: {(y, x): (200, 0) for y in range(h) for x in range(w)}
    put = lambda img, dy, dx: img | {(y + dy, x + dx): c for (y, x), c in mark.items()}
    noise = {(y, x): (rnd.randrange(256), 1) for y in range(16, 40) for x in range(40)}
    # the crops 0 and 2 hold the same content; a mark in the left crop and the same in the middle one
    left = blank(40, 40) | {(y, x): mark[y % 12, x % 22] for y in range(12) for x in range(0, 18)}
    images = {1: put(blank(40, 40), 0, 6), 2: put(blank(40, 40), 0, 6) | noise, 3: blank(40, 40), 4: put(blank(12, 40), 0, 6), 5: put(blank(53, 61), 1, 9), 6: left, 7: {(y, x): (rnd.randrange(256), int(rnd.random() < 0.3)) for y in range(30) for x in range(30)}}
    pix = spark.createDataFrame([(i, y, x, *c) for i, img in images.items() for (y, x), c in img.items()], "image_id int, y int, x int, v int, edge int")
    todo = [(i * 10 + j, i, j) for i in images for j in (1, 2, 3, 4, 5, 6, 7, 9)]
    pairs = spark.createDataFrame(todo, "pair_id int, a_id int, b_id int")
    got = {r["pair_id"]: r for r in logo.compare_regions(pairs, pix, pix, grid=(9, 15)).collect()}
    assert len(got) == len(todo)
    for p, i, j in todo:
        status, score, regions = regions_by_hand(images[i], images.get(j), 9, 15)
        assert (got[p]["status"], (got[p]["a_region"], got[p]["b_region"]) if regions else None) == (status, regions), p
        assert abs(got[p]["score"] - score) < 0.11, p
    assert (got[12]["status"], got[12]["score"]) == ("PASS", 100.0) and got[41]["status"] == "NOT_FOUND" and got[13]["status"] == "FAIL"
    # whole images call the pair different by what lies outside the crops
    whole = {r["pair_id"]: r["status"] for r in logo.compare(pairs, pix, pix).collect()}
    assert whole[12] == "FAIL" and whole[44] == "PASS"


def test_targets_take_their_next_best_word(spark):
    rnd = random.Random(13)
    pool = ["XL", "xl", "BLUE", "BLUE-2", "LUE", "SIZE", "SIZE4", "A", "AB"]
    lines = {(k, i): rnd.choices(pool, k=rnd.randint(1, 8)) for k in range(12) for i in (0, 1)}
    wants = {(k, i): rnd.choices(pool, k=rnd.randint(1, 6)) for k, i in lines}
    wants |= {(20, None): ["A 1"], (21, None): ["XL", "XL"]}
    lines |= {(20, 0): ["B", "A", "1"], (21, 0): ["XL"], (21, 1): ["SIZE", "XL"]}
    words = spark.createDataFrame([(k, i, j, j, 10 * j + 100 * i, 5, 8, 8, t) for (k, i), ts in lines.items() for j, t in enumerate(ts)], "label_id int, line_index int, word_index int, seq int, x int, y int, w int, h int, text string")
    targets = spark.createDataFrame([(k, i, n, t) for (k, i), ts in wants.items() for n, t in enumerate(ts)], "label_id int, line_index int, target_no int, target string")
    got = {(r["label_id"], r["line_index"], r["target_no"], r["word_index"], r["fit"]) for r in highlight.find_words(targets, words).collect()}
    norm = lambda x: "".join(c for c in x.upper() if c.isalnum())
    want = {(20, 0, 0, 1, 2), (20, 0, 0, 2, 2), (21, 0, 0, 0, 2), (21, 1, 1, 1, 2)}
    for (k, i), ts in wants.items():
        used: set = set()
        for n, t in enumerate(map(norm, ts if i is not None else [])):
            fits = [(2 if t == w else int(len(t) >= 3 and (t in w or w in t)), -j) for j, w in enumerate(map(norm, lines[k, i])) if j not in used]
            fit, j = max(fits, default=(0, 0))
            if fit:
                used.add(-j)
                want.add((k, i, n, -j, fit))
    assert got == want


def test_highlight_and_report(spark):
    words = spark.createDataFrame([(1, 0, i, i, 10 * i, 5, 8, 8, t) for i, t in enumerate(["SIZE", "XL", "BLUE-2", "XL"])], "label_id int, line_index int, word_index int, seq int, x int, y int, w int, h int, text string")
    targets = spark.createDataFrame([(1, 0, 0, "xl"), (1, 0, 1, "BLUE"), (1, 0, 2, "zz")], "label_id int, line_index int, target_no int, target string")
    got = {r["target_no"]: (r["word_index"], r["fit"]) for r in highlight.find_words(targets, words).collect()}
    assert got == {0: (1, 2), 1: (2, 1)}
    assert highlight.safe_boxes(words, F.lit(20), F.lit(20)).selectExpr("max(x2)").first()[0] <= 19
    rows = spark.createDataFrame([(1, "SIZE", "a<b", "", "MISSING", 0.0)], "pair_id int, field string, approval string, sample string, status string, score double")
    shown = report.field_comparison(spark.createDataFrame([(1,), (2,)], "pair_id int"), rows).collect()
    assert {(r["pair_id"], r["field"]) for r in shown} == {(1, "SIZE"), (2, "No comparable fields found.")}


def test_boxes_of_differences(spark):
    words = spark.createDataFrame(
        [(1, 0, 0, 0, "QTY:", 0, 10, 40, 20), (1, 0, 1, 1, "5", 60, 10, 10, 20), (1, 0, 2, 2, "5", 90, 10, 10, 20), (1, 1, 0, 3, "RED", 0, 50, 30, 20), (1, 1, 1, 4, "CAP", 60, 50, 30, 20)],
        "pair_id long, line_index int, word_index int, seq int, text string, x int, y int, w int, h int",
    )
    diffs = spark.createDataFrame(
        [(1, 0, "replace", "5", "6", 0, 0), (1, 1, "delete", "5", "", 0, None), (1, 2, "delete", "CAP", "", None, None), (1, 3, "insert", "", "NEW", None, 2), (1, 4, "delete", "BLUE", "", 1, None), (2, 0, "delete", "5", "", 0, None)],
        "pair_id long, diff_no int, type string, approval_text string, sample_text string, approval_line int, sample_line int",
    )
    got = {(r["diff_no"], r["color"], r["label"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in highlight.boxes(diffs, words, "approval", F.lit(100), F.lit(60)).collect()}
    # both differences of line 0 choose the first 5; CAP has no line and is found anywhere, cut at the image's edge
    assert got == {(0, "RED", "CHANGE", 57, 7, 73, 33), (1, "ORANGE", "MISSING", 57, 7, 73, 33), (2, "ORANGE", "MISSING", 57, 47, 93, 59)}


def test_boxes_of_both_sides_and_of_fields(spark):
    cols = "pair_id long, line_index int, word_index int, seq int, text string, x int, y int, w int, h int"
    a = spark.createDataFrame([(1, 0, 0, 0, "RED", 0, 0, 30, 20), (1, 0, 1, 1, "CAP", 60, 0, 30, 20)], cols)
    s = spark.createDataFrame([(1, 0, 0, 0, "BLUE", 0, 0, 40, 20), (1, 0, 1, 1, "CAP", 60, 0, 30, 20), (1, 1, 0, 2, "NEW", 0, 40, 30, 20)], cols)
    diffs = spark.createDataFrame([(1, 0, "replace", "RED", "BLUE", 0, 0), (1, 1, "insert", "", "NEW", None, 1)], "pair_id long, diff_no int, type string, approval_text string, sample_text string, approval_line int, sample_line int")
    got = {(r["side"], r["diff_no"], r["target"], r["color"], r["label"]) for r in highlight.both_sides(diffs, a, s, F.lit(100), F.lit(80)).collect()}
    assert got == {("approval", 0, "RED", "RED", "CHANGE"), ("sample", 0, "BLUE", "RED", "CHANGE"), ("sample", 1, "NEW", "BLUE", "EXTRA")}
    rows = spark.createDataFrame([(1, 1, "red cap", "blue cap", "MISMATCH"), (1, 0, "", "new", "EXTRA"), (1, 2, "x", "x", "MATCH")], "pair_id long, field_ord int, approval string, sample string, status string")
    flat = highlight.flat_differences(rows)
    assert [(r["diff_no"], r["type"], r["approval_text"], r["sample_text"], r["sample_line"]) for r in sorted(flat.collect())] == [(0, "insert", "", "NEW", None), (1, "replace", "RED", "BLUE", None)]
    assert {(r["side"], r["target"]) for r in highlight.both_sides(flat, a, s, F.lit(100), F.lit(80)).collect()} == {("approval", "RED"), ("sample", "BLUE"), ("sample", "NEW")}


def test_line_mismatches(spark):
    p = spark.createDataFrame([(1, "A\nB 1\nC", "A\nB 2"), (2, "A", "A")], "pair_id long, atext string, stext string")
    got = {(r["pair_id"], r["field"], r["approval"], r["sample"], r["status"], r["score"]) for r in compare.line_mismatches(compare.compare_lines(p)).collect()}
    assert {x[:2] + x[4:] for x in got} == {(1, "LINE 2", "MISMATCH", None), (1, "LINE 3", "MISSING", None)}


def test_engines(spark):
    raw = spark.createDataFrame([("1", " A ", "-1", "x", "2", "3", None), ("1", "  ", "9", "1", "1", "1", "1")], "label_id string, text string, confidence string, x string, y string, w string, h string")
    assert [tuple(r[c] for c in ("text", "confidence", "x", "y", "x2", "y2")) for r in ocr.clean_words(raw).collect()] == [("A", 0.0, 0, 2, 3, 2)]
    a = spark.createDataFrame([(1, 80.0), (3, 0.0)], "label_id long, confidence double")
    b = spark.createDataFrame([(1, 40.0), (2, 50.0)], "label_id long, confidence double")
    assert {tuple(r) for r in ocr.choose_engine(a, b).collect()} == {(1, "tesseract", 60.0), (2, "easyocr", 50.0), (3, "tesseract", 0.0)}


def test_rounding_of_ties_that_are_none_in_binary(spark):
    # 41 / 40 is just below 1.025; ten times the half of 0.01 + 25.69 is 128.5
    words = spark.createDataFrame([(1, float(c)) for c in [1] * 39 + [2]], "label_id long, confidence double")
    assert [r["confidence"] for r in ocr.mean_confidence(words).collect()] == [1.02]
    a = spark.createDataFrame([(1, 0.01), (2, 0.01), (3, 0.25)], "label_id long, confidence double")
    b = spark.createDataFrame([(1, 25.69), (2, 60.69)], "label_id long, confidence double")
    assert {tuple(r) for r in ocr.choose_engine(a, b).collect()} == {(1, "tesseract", 12.8), (2, "tesseract", 30.4), (3, "tesseract", 0.2)}


def test_pairs_are_compared_inside_their_rows(spark):
    """A summary of pairs needs no exchange, and its counts are those of the rows."""
    texts = ["BUYER: A\nSIZE: 4\n*\nQTY: 5 PCS", "BUYER: A\nSIZE: 4\nQTY: 6 PCS", "", None, "size :  4\r\nBUYER: A\n\nBUYER: A", "SIZE: 4\nSIZE: 4\nBUYER: A"]
    pairs = spark.createDataFrame([(i * 10 + j, a, s) for i, a in enumerate(texts) for j, s in enumerate(texts)], "pair_id long, atext string, stext string")
    got = label_qc.pair_summary(pairs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    apart = compare.summarise(pairs, compare.field_result(label_qc.field_rows(pairs)), compare.line_result(compare.compare_lines(pairs)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.select(got.columns).collect()))


def test_alignments_without_a_choice(spark):
    rnd = random.Random(17)
    lists = [[rnd.choice("ABCDEFGHIJKL") * rnd.choice((1, 1, 1, 2)) for _ in range(rnd.randint(0, 7))] for _ in range(400)]
    pairs = [(i, a, [x for x in a if rnd.random() < 0.8] + rnd.choice(lists)[: rnd.randint(0, 2)]) for i, a in enumerate(lists)]
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(s)) for i, a, s in pairs], "pair_id int, atext string, stext string")
    got = {(r["pair_id"], r["approval_line"], r["sample_line"], r["status"]) for r in compare.compare_lines(df).collect()}
    want = set()
    for i, a, s in pairs:
        for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, s, autojunk=False).get_opcodes():
            for k in range(max(i2 - i1, j2 - j1)):
                x, y = i1 + k if i1 + k < i2 else None, j1 + k if j1 + k < j2 else None
                want.add((i, x, y, "MATCH" if tag == "equal" else "MISSING" if y is None else "EXTRA" if x is None else "MISMATCH"))
    assert got == want


def test_targets_that_all_have_their_word_need_no_search(spark):
    cases = {0: ("A B A", "A B A"), 1: ("B A", "A C B"), 2: ("A A", "A B A"), 3: ("A D", "A B"), 4: ("ABC", "ABCD ABC"), 5: ("ABC ABCD", "ABCD ABC X")}
    rows = spark.createDataFrame([(i, [(k, x) for k, x in enumerate(t.split())], w.split()) for i, (t, w) in cases.items()], "id int, ts array<struct<target_no: int, tk: string>>, wks array<string>")
    rows = rows.withColumn("ws", F.transform("wks", lambda w: F.struct(w.alias("wk"))))
    settled, places = highlight._settled()
    assert {r["id"]: r["p"] for r in rows.select("id", F.when(settled, places).alias("p")).collect()} == {0: [0, 1, 2], 1: [2, 0], 2: None, 3: None, 4: [1], 5: [1, 0]}
    words = [(i, 0, j, j, 10 * j, 5, 8, 8, x) for i, (_, w) in cases.items() for j, x in enumerate(w.split())]
    words = spark.createDataFrame(words, "label_id int, line_index int, word_index int, seq int, x int, y int, w int, h int, text string")
    targets = spark.createDataFrame([(i, 0, n, x) for i, (t, _) in cases.items() for n, x in enumerate(t.split())], "label_id int, line_index int, target_no int, target string")
    got = {(r["label_id"], r["target_no"]): (r["word_index"], r["fit"]) for r in highlight.find_words(targets, words).collect()}
    assert got == {(0, 0): (0, 2), (0, 1): (1, 2), (0, 2): (2, 2), (1, 0): (2, 2), (1, 1): (0, 2), (2, 0): (0, 2), (2, 1): (2, 2), (3, 0): (0, 2), (4, 0): (1, 2), (5, 0): (1, 2), (5, 1): (0, 2)}
