"""Shape of the executed plans that the scale design relies on."""

import io
from contextlib import redirect_stdout

from tillroll.operators import basket
from tillroll.plans.basket_queries import _prepared


def final_plan(df) -> str:
    df.collect()
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("== Initial Plan ==")[0]


def test_partner_ranks_limit_before_the_shuffle(spark, sf_small):
    rows = _prepared(spark, sf_small)
    pairs = basket.pair_counts(basket.basket_cells(rows, "prod_name"), "prod_name")
    plan = final_plan(basket.ranked_partners(pairs, 3))
    body = plan.split("\n\n(")[0]
    # a partial WindowGroupLimit sits below the exchange that feeds the window
    assert body.count("WindowGroupLimit") >= 4
    lines = [line for line in body.splitlines() if "WindowGroupLimit" in line or "Exchange" in line]
    assert any("Exchange" in a and "WindowGroupLimit" in b for a, b in zip(lines, lines[1:]))


def test_partner_tops_shuffle_no_table_of_all_pairs(spark, sf_small):
    plan = final_plan(basket.partner_tops(_prepared(spark, sf_small), "prod_name", 3)).split("\n\n(")[0]
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Exchange" in line or "Join" in line]
    # the only exchange above the pairs' sums takes what a partial limit left
    first = next(k for k, line in enumerate(limits) if "Exchange" in line and "Broadcast" not in line)
    assert "WindowGroupLimit" in limits[first - 1] and "WindowGroupLimit" in limits[first + 1]


def test_pairs_come_from_one_join(spark, sf_small):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sized = basket.materialized_cells(_prepared(spark, sf_small), "prod_name")
        body = final_plan(basket.pair_counts_sized(sized, "prod_name")).split("\n\n(")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert body.count("SortMergeJoin") == 1 and "Union" not in body


def explained(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_report_reads_only_the_written_cells(spark, sf_small):
    text = explained(basket.co_purchase_report(_prepared(spark, sf_small), "prod_name", 3))
    assert "lineitem.parquet" not in text and "cells-" in text


def test_equal_values_are_cut_into_many_ranges(spark):
    from pyspark.sql import functions as F
    from tillroll.operators.ordered import running_sum_desc
    df = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranged = df.repartitionByRange(F.col("v").desc(), F.col("k").asc()).where("v = 7").select(F.spark_partition_id())
        assert ranged.distinct().count() >= 3  # of 8
        out = running_sum_desc(df.withColumn("one", F.lit(1)), "v", "k", "rank", summed="one")
        assert [r["rank"] for r in out.orderBy(F.col("v").desc(), "k").select("rank").collect()] == list(range(1, 20_001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_forecast_panel_reads_the_input_once_more_after_its_statistics(spark, sf_small):
    import re
    from tillroll.plans.panel_queries import product_daily
    df = product_daily(spark, sf_small)
    df.collect()
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("== Initial Plan ==")[0]
    ids = set(re.findall(r"Scan parquet\s+\((\d+)\)", tree))
    details = {blk.split(")")[0]: blk for blk in text.split("\n\n(")[1:]}
    lineitem = [i for i in ids if "lineitem.parquet" in details.get(i, "")]
    # The statistics pass has been written; the main pass is left.
    assert len(lineitem) == 1


def test_tables_of_many_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A table is judged by its rows, whatever the size of its files."""
    from pyspark.sql import functions as F
    from tillroll.operators import prep
    from tillroll.sources import testdata
    k = F.col("id")
    spark.range(3_000).select(k.alias("p_partkey"), F.lit("red small").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("TIN").alias("p_type"),
                              F.lit(10.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(50).select(k.alias("o_orderkey"), (k % 9).alias("o_custkey"), F.expr("timestamp'2022-01-01'").alias("o_orderdate"),
                           F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(400).select((k % 60).alias("l_orderkey"), (k * 11 % 4_000).alias("l_partkey"), F.lit(0.1).alias("l_discount"), F.lit(2.0).alias("l_quantity"),
                            F.expr("timestamp'2022-01-02'").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")

    def loaded():
        t = testdata.load_retail_tables(spark, str(tmp_path))
        return prep.prepare_forecast_rows(t.transactions, t.articles), t.transaction_grid

    joins = lambda df: [final_plan(df).split("\n\n(")[0].count(j) for j in ("BroadcastHashJoin", "SortMergeJoin")]
    small = [sorted(map(str, df.collect())) for df in loaded()]
    monkeypatch.setattr(testdata, "BROADCAST_ROWS", 1_000)  # orders may be broadcast, parts not
    rows, grid = loaded()
    assert [sorted(map(str, df.collect())) for df in (rows, grid)] == small and all(small)
    assert joins(rows) == [1, 2] and joins(grid) == [0, 1]
