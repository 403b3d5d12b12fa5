"""Feature tables.

Both tables are one ``select`` over a daily panel: date parts and flags are
scalar expressions, one-hot columns use a fixed vocabulary (no fit pass),
and trend / Fourier / moving-average terms are windows per series key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.calendar import date_part_map, fourier_map, one_hot_map, year_flag
from tillroll.operators.calendar_dim import with_holiday_flag

# Feature names of the product-level model table, in order.
PRODUCT_FEATURES = [
    "Year", "Week", "Day", "Dayofyear", "price",
    "Is_month_end", "Is_month_start", "Is_quarter_end", "Is_quarter_start",
    "Is_year_end", "Is_year_start",
    "Dayofweek_0", "Dayofweek_1", "Dayofweek_2", "Dayofweek_3", "Dayofweek_4",
    "Dayofweek_5", "Dayofweek_6",
    "Month_1", "Month_2", "Month_3", "Month_4", "Month_5", "Month_6",
    "Month_7", "Month_8", "Month_9", "Month_10", "Month_11", "Month_12",
]

# Feature names of the style-level model table, in order.
STYLE_FEATURES = [
    "final_price", "is_promotion", "holiday_flag", "transaction_Year",
    "transaction_Week", "transaction_Day", "transaction_Is_month_end",
    "transaction_Is_month_start", "transaction_Is_quarter_end",
    "transaction_Is_quarter_start", "transaction_Is_year_end",
    "transaction_Is_year_start", "sin_4_1", "cos_4_1", "sin_4_2", "cos_4_2",
    "sin_4_3", "cos_4_3", "sin_4_4", "cos_4_4", "trend", "MA",
    "transaction_Month_1", "transaction_Month_2", "transaction_Month_3",
    "transaction_Month_4", "transaction_Month_5", "transaction_Month_6",
    "transaction_Month_7", "transaction_Month_8", "transaction_Month_9",
    "transaction_Month_10", "transaction_Month_11", "transaction_Month_12",
    "transaction_Dayofweek_0", "transaction_Dayofweek_1",
    "transaction_Dayofweek_2", "transaction_Dayofweek_3",
    "transaction_Dayofweek_4", "transaction_Dayofweek_5",
    "transaction_Dayofweek_6",
]


def centred_moving_average(value: str, key: str, order_col: str, window: int = 52,
                           min_periods: int = 26):
    """Centred rolling mean over ``window`` rows (rows -w/2 .. w/2-1 for
    even ``window``), null when fewer than ``min_periods`` values exist."""
    before = window // 2
    after = window - before - 1
    w = Window.partitionBy(key).orderBy(order_col).rowsBetween(-before, after)
    return F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w))


def trailing_moving_average(value: str, key: str, order_col: str, window: int = 52,
                            min_periods: int = 26):
    """Mean of the ``window`` rows *before* the current row (no target leak)."""
    w = Window.partitionBy(key).orderBy(order_col).rowsBetween(-window, -1)
    return F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w))


def trend_index(key: str, order_col: str):
    """Linear trend 1..n per key."""
    return F.row_number().over(Window.partitionBy(key).orderBy(order_col))


def product_calendar(date: str) -> dict:
    """The 29 calendar features of T22 by name, for the day in ``date``."""
    d = F.col(date)
    named = date_part_map(d, parts=["Year", "Week", "Day", "Dayofyear", "Is_month_end",
                                    "Is_month_start", "Is_quarter_end", "Is_quarter_start",
                                    "Is_year_end", "Is_year_start"])
    named.update(one_hot_map(F.weekday(d), range(7), "Dayofweek_"))
    named.update(one_hot_map(F.month(d), range(1, 13), "Month_"))
    return named


def product_features(daily: DataFrame, key: str = "product_code", date: str = "date") -> DataFrame:
    """``(key, date, sales)`` + the 30 product-model features."""
    named = product_calendar(date)
    return daily.select(key, date, "sales", *[named.get(n, F.col(n)) for n in PRODUCT_FEATURES])


def style_calendar(date: str, position, fourier_freq: int = 4, fourier_order: int = 4) -> dict:
    """The calendar, Fourier and trend features of T23 by name, for the day
    in ``date`` at the 0-based ``position`` in its series."""
    d = F.col(date)
    named = date_part_map(d, prefix="transaction_",
                          parts=["Week", "Day", "Is_month_end", "Is_month_start",
                                 "Is_quarter_end", "Is_quarter_start", "Is_year_end",
                                 "Is_year_start"])
    named["transaction_Year"] = year_flag(F.year(d)).alias("transaction_Year")
    named.update(fourier_map(position, fourier_freq, fourier_order))
    named["trend"] = (position + 1).alias("trend")
    named.update(one_hot_map(F.month(d), range(1, 13), "transaction_Month_"))
    named.update(one_hot_map(F.weekday(d), range(7), "transaction_Dayofweek_"))
    return named


def style_features(panel: DataFrame, holidays: DataFrame, key: str = "style_group",
                   date: str = "transaction_date", ma: str = "centred",
                   fourier_freq: int = 4, fourier_order: int = 4) -> DataFrame:
    """``(key, date, units_sold)`` + the 41 style-model features.

    ``ma='centred'`` reproduces the reference's centred 52-row mean (it
    includes the day being predicted, N18); ``'trailing'`` uses only past
    rows.  The year flag compares the year as a number (N9).
    """
    flagged = with_holiday_flag(panel, date, holidays)
    t0 = F.row_number().over(Window.partitionBy(key).orderBy(date)) - 1
    named = style_calendar(date, t0, fourier_freq, fourier_order)
    ma_col = (centred_moving_average("units_sold", key, date) if ma == "centred"
              else trailing_moving_average("units_sold", key, date))
    named["MA"] = ma_col.alias("MA")
    return flagged.select(key, date, "units_sold", *[named.get(n, F.col(n)) for n in STYLE_FEATURES])
