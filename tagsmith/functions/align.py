"""Sequence alignment (longest matching block, earliest first, recursive) as Arrow UDFs.

Spark has no such alignment and Levenshtein distance is another measure. The kernel is the standard library's; equal
and empty inputs are settled by native branches before it, and it never sees more than one pair's two sequences.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tagsmith.deploy import ship
from tagsmith.functions.text import compare_form, key_form, tokens

WORD_DIFF = "struct<type:string,approval:array<string>,sample:array<string>,approval_text:string,sample_text:string>"
CHAR_DIFF = "struct<type:string,approval:string,sample:string,approval_start:int,approval_end:int,sample_start:int,sample_end:int>"
OPCODE = "struct<tag:string,i1:int,i2:int,j1:int,j2:int>"


def _opcodes(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    for i in np.flatnonzero((a.notna() & b.notna()).to_numpy()):
        out[i] = SequenceMatcher(None, a.iat[i], b.iat[i], autojunk=False).ratio()
    return pd.Series(out)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if xs is None else [None if x is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(xs, ys, strict=True)] for xs, ys in zip(a, b, strict=True)]
    return pd.Series(out)


def _word_diffs(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        out.append([{"type": t, "approval": x[i:j], "sample": y[k:m], "approval_text": " ".join(x[i:j]), "sample_text": " ".join(y[k:m])} for t, i, j, k, m in _opcodes(x, y) if t != "equal"])
    return pd.Series(out)


def _char_diffs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"type": t, "approval": x[i:j], "sample": y[k:m], "approval_start": i, "approval_end": j, "sample_start": k, "sample_end": m} for t, i, j, k, m in _opcodes(x, y) if t != "equal"] for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


def _line_ops(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        out.append([{"tag": t, "i1": i, "i2": j, "j1": k, "j2": m} for t, i, j, k, m in _opcodes(x, y)])
    return pd.Series(out)


def _udf(f, kind: str):
    ship(SparkSession.active())
    return F.pandas_udf(f, kind)


def key_similarity(a: Column, b: Column) -> Column:
    """2 M / T over key forms; 1 for two empty ones, 0 for one. The rows with a native answer reach the UDF as nulls."""
    easy = (a == b) | (a == "") | (b == "")
    ratio = _udf(_ratio, "double")(F.when(~easy, a), F.when(~easy, b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(ratio)


def key_ratios(a: Column, b: Column) -> Column:
    """2 M / T of each element of two arrays of key forms, null where the element is; null for null arrays."""
    return _udf(_ratios, "array<double>")(a, b)


def similarity(left: Column, right: Column) -> Column:
    return key_similarity(key_form(left), key_form(right))


def word_diffs(left: Column, right: Column) -> Column:
    return _udf(_word_diffs, f"array<{WORD_DIFF}>")(tokens(left), tokens(right))


def char_diffs(left: Column, right: Column) -> Column:
    return _udf(_char_diffs, f"array<{CHAR_DIFF}>")(compare_form(left), compare_form(right))


def line_opcodes(left: Column, right: Column) -> Column:
    """Opcodes that turn the array left into the array right."""
    return _udf(_line_ops, f"array<{OPCODE}>")(left, right)
