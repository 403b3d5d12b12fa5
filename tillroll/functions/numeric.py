"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col, scale: int = 0) -> Column:
    """Round to nearest, ties to even (numpy/pandas ``round``): 2.5 -> 2."""
    return F.bround(_c(col), scale)


def clamp_at_zero(col) -> Column:
    """Negative values become 0 (null stays null)."""
    c = _c(col)
    return F.when(c < 0, F.lit(0)).otherwise(c)
