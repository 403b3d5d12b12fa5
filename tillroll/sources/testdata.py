"""Mapping of the provided TPC-H-style tables onto the retail inputs.

The retail operators need ``transactions``, ``articles``,
``transaction_grid`` and a ``holidays`` dimension.  They are derived here,
lazily, from ``orders``, ``lineitem`` and ``part``:

* transactions: one row per line item; day = order date, customer = SHA-256
  hex text of the customer key (so the hex-key function gets real input),
  article = part key, price = retail price x (1 - discount) computed in
  decimal, channel = leading digit of the order priority.
* articles: one row per part; product code = part key div 10, name, type
  and brand as name / type / group.
* transaction_grid: one row per line item; style = name + type, colour
  variant = style + brand, level3 / level4 = second / first word of the
  name, units = quantity, final price = discounted price.
* holidays: built by rule for every year the data spans (see
  :func:`tillroll.operators.calendar_dim.holiday_table`).

The same definitions are written in DuckDB SQL in
:mod:`tillroll.plans.oracle` so both engines see identical inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class RetailTables:
    transactions: DataFrame
    articles: DataFrame
    transaction_grid: DataFrame
    holidays: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a table that a join may send whole to the driver and every executor.
BROADCAST_ROWS = 1_000_000


def broadcast_bounded(df: DataFrame) -> DataFrame:
    """``df`` to be joined to: above ``BROADCAST_ROWS`` rows with the hint that
    its joins shuffle both sides.  Spark judges a table by the size of its
    files, and Parquet says little of the rows: 46 MB hold 7.2 million parts,
    which take 326 MB each time they are broadcast.  The count reads no column."""
    return df.hint("merge") if df.count() > BROADCAST_ROWS else df


def discounted_price(retail="p_retailprice", discount="l_discount"):
    """Exact decimal product, then double: identical in every engine."""
    return (F.col(retail).cast("decimal(12,2)")
            * (F.lit(1) - F.col(discount).cast("decimal(4,2)"))).cast("double")


def transactions_from(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_discount")
    od = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    pt = part.select("p_partkey", "p_retailprice")
    joined = (li.join(od, li.l_orderkey == od.o_orderkey)
                .join(pt, li.l_partkey == pt.p_partkey, "left"))
    return joined.select(
        F.to_date("o_orderdate").alias("t_dat"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("customer_id"),
        F.col("l_partkey").cast("int").alias("article_id"),
        discounted_price().alias("price"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("sales_channel_id"),
    )


def articles_from(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").cast("int").alias("article_id"),
        F.expr("p_partkey div 10").cast("int").alias("product_code"),
        F.col("p_name").alias("prod_name"),
        (F.ascii("p_type") * 100 + F.ascii(F.substring("p_type", 2, 1))).cast("int").alias("product_type_no"),
        F.col("p_type").alias("product_type_name"),
        F.col("p_brand").alias("product_group_name"),
    )


def transaction_grid_from(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    li = lineitem.select("l_partkey", "l_quantity", "l_discount", "l_shipdate")
    pt = part.select("p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    day = F.to_date("l_shipdate")
    season_start = F.trunc(day, "quarter")
    style = F.concat(F.col("p_name"), F.lit("_"), F.col("p_type"))
    return j.select(
        F.concat(style, F.lit("_"), F.col("p_brand")).alias("style_color_group"),
        style.alias("style_group"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("level3"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("level4"),
        day.alias("transaction_date"),
        F.lit("online").alias("sales_channel"),
        F.col("l_quantity").cast("int").alias("units_sold"),
        F.col("p_retailprice").alias("original_price"),
        F.col("p_retailprice").alias("sales_price"),
        discounted_price().alias("final_price"),
        (F.col("l_discount") > 0).cast("int").alias("is_promotion"),
        F.date_format(day, "yyyy-MM").alias("month_of_launch"),
        F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")).alias("current_season"),
        F.concat(F.year(day).cast("string"), F.when(F.month(day) <= 6, F.lit("-H1")).otherwise(F.lit("-H2"))).alias("initial_season"),
        season_start.alias("season_start_date"),
        F.last_day(F.add_months(season_start, 2)).alias("season_end_date"),
    )


def load_retail_tables(spark: SparkSession, sf_dir: str) -> RetailTables:
    from tillroll.operators.calendar_dim import holiday_table

    lineitem = _read(spark, sf_dir, "lineitem")
    orders = broadcast_bounded(_read(spark, sf_dir, "orders"))
    part = broadcast_bounded(_read(spark, sf_dir, "part"))
    tx = transactions_from(lineitem, orders, part)
    grid = transaction_grid_from(lineitem, part)
    return RetailTables(
        transactions=tx,
        articles=articles_from(part),
        transaction_grid=grid,
        # Year range from one pruned column of lineitem (no join needed).
        holidays=holiday_table(lineitem.select(F.to_date("l_shipdate").alias("d"))),
    )
