"""Calendar features as built-in expressions.

Names follow the date-part convention used by the reference feature tables:
``Year, Month, Week, Day, Dayofweek, Dayofyear, Is_month_end,
Is_month_start, Is_quarter_end, Is_quarter_start, Is_year_end,
Is_year_start, Elapsed`` with an optional prefix.  ``Dayofweek`` counts
Monday as 0 and ``Week`` is the ISO week, as in pandas.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Names of the date parts, in the order the feature tables use.
DATE_PARTS = ["Year", "Month", "Week", "Day", "Dayofweek", "Dayofyear",
              "Is_month_end", "Is_month_start", "Is_quarter_end",
              "Is_quarter_start", "Is_year_end", "Is_year_start", "Elapsed"]
FLAG_PARTS = ["Is_month_end", "Is_month_start", "Is_quarter_end",
              "Is_quarter_start", "Is_year_end", "Is_year_start"]

# Months of the meteorological seasons.
MONTHS_OF_SEASON = {"spring": [3, 4, 5], "summer": [6, 7, 8], "autumn": [9, 10, 11], "winter": [12, 1, 2]}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def date_part_columns(date_col, prefix: str = "", parts=None) -> list[Column]:
    """Date parts of ``date_col`` as a list of aliased columns."""
    return list(date_part_map(date_col, prefix, parts).values())


def date_part_map(date_col, prefix: str = "", parts=None) -> dict[str, Column]:
    """Date parts of ``date_col`` as ``{name: aliased column}``."""
    d = _c(date_col)
    quarter_start = F.trunc(d, "quarter")
    exprs = {
        "Year": F.year(d),
        "Month": F.month(d),
        "Week": F.weekofyear(d),
        "Day": F.dayofmonth(d),
        "Dayofweek": F.weekday(d),
        "Dayofyear": F.dayofyear(d),
        "Is_month_end": (d == F.last_day(d)).cast("int"),
        "Is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "Is_quarter_end": (d == F.last_day(F.add_months(quarter_start, 2))).cast("int"),
        "Is_quarter_start": (d == quarter_start).cast("int"),
        "Is_year_end": ((F.month(d) == 12) & (F.dayofmonth(d) == 31)).cast("int"),
        "Is_year_start": ((F.month(d) == 1) & (F.dayofmonth(d) == 1)).cast("int"),
        # Seconds since the epoch at midnight UTC, independent of the session zone.
        "Elapsed": (F.unix_date(d).cast("bigint") * 86400),
    }
    return {prefix + p: exprs[p].alias(prefix + p) for p in (parts or DATE_PARTS)}


def one_hot_map(col, values, prefix: str) -> dict[str, Column]:
    """Fixed-vocabulary one-hot columns ``{prefix}{v}`` as 0/1 ints (no fit
    pass over the data)."""
    c = _c(col)
    return {f"{prefix}{v}": (c == F.lit(v)).cast("int").alias(f"{prefix}{v}") for v in values}


def month_abbr(date_col) -> Column:
    """Three-letter English month name ('Jan' ...)."""
    return F.date_format(_c(date_col), "MMM")


def season_of_month(month_col) -> Column:
    """Season name for a month number."""
    m = _c(month_col)
    expr = None
    for season, months in MONTHS_OF_SEASON.items():
        cond = m.isin(months)
        expr = F.when(cond, season) if expr is None else expr.when(cond, season)
    return expr


def fourier_coefficient(freq: float, i: int) -> float:
    """Angular step ``2*pi*i/freq`` (the SQL oracle uses the same literal)."""
    return 2.0 * math.pi * i / freq


def fourier_columns(time_col, freq: float, order: int) -> list[Column]:
    """``sin_{freq}_{i}``, ``cos_{freq}_{i}`` of ``2*pi*i*t/freq``, i = 1..order."""
    return list(fourier_map(time_col, freq, order).values())


def fourier_map(time_col, freq: float, order: int) -> dict[str, Column]:
    t = _c(time_col).cast("double")
    out = {}
    label = int(freq) if float(freq).is_integer() else freq
    for i in range(1, order + 1):
        arg = t * F.lit(fourier_coefficient(freq, i))
        out[f"sin_{label}_{i}"] = F.sin(arg).alias(f"sin_{label}_{i}")
        out[f"cos_{label}_{i}"] = F.cos(arg).alias(f"cos_{label}_{i}")
    return out


def week_ending_sunday(date_col) -> Column:
    """The Sunday that closes the (Monday-start) week of ``date_col``."""
    return F.date_add(F.trunc(_c(date_col), "week"), 6)


def year_flag(year_col, year: int = 2022) -> Column:
    """0 for ``year``, else 1 (compared as a number)."""
    return F.when(_c(year_col) == year, 0).otherwise(1)
