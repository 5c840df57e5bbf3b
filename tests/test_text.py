import pytest
from pyspark.sql import functions as F

from tagsmith.functions import text as T

#: What each form makes of given texts.
CASES = {
    "compare_form": (T.compare_form, {None: "", " a\t b ": "A B", "M—N–O−P “q” ‘r’ s|t": "M-N-O-P \"Q\" 'R' SIT", "Straße é": "STRASSE É", "a\r\nb\x0bc\n\n d": "A B C D", "\xa0x y\x85": "X Y"}),
    "key_form": (T.key_form, {None: "", "Straße é!": "STRASSE", "M—N 1.5": "MN15", "***": "", "s|t": "SIT"}),
    "tokens": (T.tokens, {None: [], "12.50% ABC-1/2 x": ["12.50", "ABC-1/2", "X"], "--": [], "a%b c. d..e": ["A%B", "C", "D", "E"]}),
    "numbers": (T.numbers, {None: [], "12.5kg 3 4.0.1": ["12.5", "3", "4.0", "1"], ".5 6.": ["5", "6"]}),
    "line_form": (T.line_form, {None: "", " a\t\tb ": "a b", "a—b\n\n\nc": "a-b\nc", "\xa0x\xa0y\xa0": "x\xa0y"}),
    "clean_value": (T.clean_value, {None: "", " :=- 5 kg ;|": "5 kg", "- 7 -": "7 -", "-12": "12", ",a ,": "a ,"}),
    "is_noise": (T.is_noise, {None: True, "*": True, "7": True, "é1": True, "a-b": False, "--": True}),
    "barcode_form": (T.barcode_form, {None: "", "ctn 25006025\r\n": "CTN25006025", "a_b-c.d/e#": "A_B-C.D/E", "é": ""}),
    "lines": (T.lines, {None: [], "a\r\nb\x0bc\n\n d e": ["A", "B", "C", "D", "E"], " \n\t": []}),
    "or_default": (T.or_default, {None: "-", "  ": "-", " x ": "x"}),
    "label_form": (T.label_form, {" po_no.: ": "PO NO", "G.W.": "G.W", "CARTON -- NO|": "CARTON NO", None: ""}),
    "status_color": (T.status_color, {" pass": "#198754", "MISSING": "#FD7E14", "?": "#6C757D", None: "#6C757D"}),
    "markup": (T.markup, {"<a>&\nb": "&lt;a&gt;&amp;<br/>b", None: "-"}),
}


@pytest.mark.parametrize("name", CASES)
def test_forms(spark, name):
    form, known = CASES[name]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(known)], "i int, s string").select("i", form(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in sorted(rows)] == list(known.values())
