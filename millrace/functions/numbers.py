"""Rounding that does not hang on how a quotient is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b of longs (a >= 0, b > 0) to two digits, halves up, by whole numbers; null for b = 0."""
    return F.call_function("div", a * 200 + b, F.nullif(b * 2, F.lit(0).cast("long"))) / F.lit(100.0)


def percent(a: Column, b: Column) -> Column:
    """100 * a / b of longs to two digits, as ``ratio``."""
    return ratio(a * 100, b)
