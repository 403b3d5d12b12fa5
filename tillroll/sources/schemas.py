"""Explicit input schemas (no inference) and an early column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("t_dat", T.DateType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("article_id", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("sales_channel_id", T.IntegerType()),
])

ARTICLES = T.StructType([
    T.StructField("article_id", T.IntegerType()),
    T.StructField("product_code", T.IntegerType()),
    T.StructField("prod_name", T.StringType()),
    T.StructField("product_type_no", T.IntegerType()),
    T.StructField("product_type_name", T.StringType()),
    T.StructField("product_group_name", T.StringType()),
])

TRANSACTION_GRID = T.StructType([
    T.StructField("style_color_group", T.StringType()),
    T.StructField("style_group", T.StringType()),
    T.StructField("level3", T.StringType()),
    T.StructField("level4", T.StringType()),
    T.StructField("transaction_date", T.DateType()),
    T.StructField("sales_channel", T.StringType()),
    T.StructField("units_sold", T.IntegerType()),
    T.StructField("original_price", T.DoubleType()),
    T.StructField("sales_price", T.DoubleType()),
    T.StructField("final_price", T.DoubleType()),
    T.StructField("is_promotion", T.IntegerType()),
    T.StructField("month_of_launch", T.StringType()),
    T.StructField("current_season", T.StringType()),
    T.StructField("initial_season", T.StringType()),
    T.StructField("season_start_date", T.DateType()),
    T.StructField("season_end_date", T.DateType()),
])

HOLIDAYS = T.StructType([
    T.StructField("holiday_date", T.DateType()),
    T.StructField("holiday_name", T.StringType()),
])


def require_columns(df: DataFrame, columns, what: str = "input") -> DataFrame:
    """Fail early (at plan time) when ``df`` lacks any of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}; has {df.columns}")
    return df
