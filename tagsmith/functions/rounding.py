"""Rounding to decimal places of doubles by scaling, as DuckDB and most other engines do it.

Spark's own round and bround work on a double's shortest decimal text, where 1.025 is a tie; as a double it lies below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, places: int) -> Column:
    """Ties of the scaled value away from zero."""
    scale = float(10**places)
    return F.round(c * scale) / scale


def half_even(c: Column, places: int) -> Column:
    """Ties of the scaled value to the even neighbour."""
    scale = float(10**places)
    return F.rint(c * scale) / scale
