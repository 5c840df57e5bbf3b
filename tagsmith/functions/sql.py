"""The comparison in SQL text: forms and decisions as SQL functions that Spark puts into the plan, line alignment as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tagsmith.deploy import ship
from tagsmith.functions.text import LINE_END, SPACE


def _text(x: str) -> str:
    return f"coalesce(cast({x} as string), '')"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _norm(x: str) -> str:
    return f"""trim(regexp_replace(translate(upper({_text(x)}), '—–−“”‘’|', "---\\"\\"''I"), {_quoted(f'[{SPACE}]+')}, ' '))"""


def _key(x: str) -> str:
    return f"regexp_replace({_norm(x)}, '[^A-Z0-9]', '')"


def _numbers(x: str) -> str:
    return rf"regexp_extract_all({_text(x)}, r'[0-9]+(?:\.[0-9]+)?', 0)"


#: name: (parameters, result type, expression). Each is an expression of Spark's own functions, so a query with them is one plan.
FUNCTIONS = {
    "label_norm": ("v STRING", "STRING", _norm("v")),
    "label_key": ("v STRING", "STRING", _key("v")),
    "label_numbers": ("v STRING", "ARRAY<STRING>", _numbers("v")),
    "label_lines": ("v STRING", "ARRAY<STRING>", f"filter(transform(split({_text('v')}, {_quoted(LINE_END)}), x -> {_norm('x')}), x -> x <> '')"),
    "tolerant_equal": ("a STRING, s STRING", "BOOLEAN", f"{_key('a')} <> '' AND {_key('a')} = {_key('s')}"),
    "numeric_difference": ("a STRING, s STRING", "BOOLEAN", f"CASE WHEN size({_numbers('a')}) = 0 THEN false WHEN size({_numbers('s')}) = 0 THEN true ELSE {_numbers('a')} <> {_numbers('s')} END"),
    "overall_score": ("total BIGINT, score DOUBLE, logo STRING, barcode STRING", "DOUBLE", """CASE WHEN total > 0 OR logo IN ('PASS', 'FAIL') OR barcode IN ('PASS', 'FAIL') THEN
      (if(total > 0, score * 0.85D, 0D) + if(logo = 'PASS', 0.10D, 0D) + if(barcode = 'PASS', 0.05D, 0D)) / (if(total > 0, 0.85D, 0D) + if(logo IN ('PASS', 'FAIL'), 0.10D, 0D) + if(barcode IN ('PASS', 'FAIL'), 0.05D, 0D)) ELSE 0D END"""),
}


class _AlignedLines:
    """Rows of one pair's lines; a pair goes in as two arrays and each row comes out by itself."""

    def eval(self, a: list, s: list) -> Iterator[tuple]:
        from difflib import SequenceMatcher

        a, s = list(a or []), list(s or [])
        for tag, i, j, k, m in SequenceMatcher(None, a, s, autojunk=False).get_opcodes():
            for n in range(max(j - i, m - k)):
                left, right = i + n if i + n < j else None, k + n if k + n < m else None
                yield tag == "equal", left, right, a[left] if left is not None else "", s[right] if right is not None else ""


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, and aligned_lines(a, s) as a table function for lateral joins."""
    ship(spark)
    for name, (parameters, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
    spark.udtf.register("aligned_lines", F.udtf(_AlignedLines, returnType="same boolean, approval_line int, sample_line int, approval string, sample string"))


#: line_align as one query in SQL text, over a view pairs (pair_id, atext, stext).
LINE_ALIGN = """SELECT pair_id, approval_line, sample_line, approval, sample,
  CASE WHEN same THEN 'MATCH' WHEN sample_line IS NULL THEN 'MISSING' WHEN approval_line IS NULL THEN 'EXTRA' WHEN tolerant_equal(approval, sample) THEN 'MATCH' ELSE 'MISMATCH' END AS status,
  coalesce(approval_line, sample_line) + 1 AS line
FROM (SELECT pair_id, label_lines(atext) AS a, label_lines(stext) AS s FROM pairs) p, LATERAL aligned_lines(p.a, p.s)"""
