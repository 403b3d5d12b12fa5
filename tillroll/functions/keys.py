"""Key functions: customer key from hex text, order key, composite keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hex_tail_to_long(col, digits: int = 16) -> Column:
    """Last ``digits`` hex characters read as a signed 64-bit integer.

    ``conv`` with a negative target base returns the two's-complement value,
    so ``'ffffffffffffffff'`` becomes -1 exactly as a 64-bit wrap would.
    """
    return F.conv(F.substring(_c(col), -digits, digits), 16, -10).cast("bigint")


def order_instance(customer_col, date_col) -> Column:
    """Printable order key: customer id text followed by the ISO day.

    Internally operators group on the two columns instead of this string; the
    day is always ten characters, so both forms identify the same orders.
    """
    return F.concat(_c(customer_col).cast("string"), F.date_format(_c(date_col), "yyyy-MM-dd"))


def l3_l4_key(level3="level3", level4="level4") -> Column:
    """``level3 + '_' + level4``; null when either part is null."""
    return F.concat(_c(level3), F.lit("_"), _c(level4))
