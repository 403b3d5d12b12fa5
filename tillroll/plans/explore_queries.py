"""Registered queries: counts, inventories, profiles, histograms, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import explore, prep
from tillroll.plans.basket_queries import _prepared
from tillroll.plans.registry import finish, query, tables
from tillroll.plans.sqlparts import base, prepared_basket, r6, tx_keyed, with_ctes
from tillroll.plans.basket_queries import REPORT_PENETRATION

PROFILE_COLS = ["units_sold", "original_price", "sales_price", "final_price", "is_promotion"]
TOP_K = 10

_COUNTS = {"n_customers": ["customer_id"], "n_orders": ["customer_id", "t_dat"], "n_products": ["product_code"],
           "n_articles": ["article_id"], "n_types": ["product_type_no"], "n_groups": ["product_group_name"]}


@query("distinct_counts", with_ctes("""
SELECT (SELECT count(DISTINCT customer_id) FROM prepared) AS n_customers,
       (SELECT count(*) FROM (SELECT DISTINCT customer_id, t_dat FROM prepared WHERE customer_id IS NOT NULL AND t_dat IS NOT NULL)) AS n_orders,
       (SELECT count(DISTINCT product_code) FROM prepared) AS n_products,
       (SELECT count(DISTINCT article_id) FROM prepared) AS n_articles,
       (SELECT count(DISTINCT product_type_no) FROM prepared) AS n_types,
       (SELECT count(DISTINCT product_group_name) FROM prepared) AS n_groups""",
                                    *base("transactions", "articles"), *prepared_basket(REPORT_PENETRATION)))
def distinct_counts(spark, sf_dir):
    return finish(explore.distinct_counts(_prepared(spark, sf_dir), _COUNTS))


def _inventory_sql(by: list[str], members: list[str]) -> str:
    cols = ", ".join(f"CAST(count(DISTINCT {m}) AS BIGINT) AS {m}_nunique, "
                     f"array_to_string(list_sort(list(DISTINCT {m}) FILTER (WHERE {m} IS NOT NULL)), '|') AS {m}_unique"
                     for m in members)
    return with_ctes(f"SELECT {', '.join(by)}, {cols} FROM grid WHERE {by[0]} IS NOT NULL GROUP BY {', '.join(by)}",
                     *base("grid"))


@query("level_inventory", _inventory_sql(["level3"], ["level4", "style_color_group", "style_group"]))
def level_inventory(spark, sf_dir):
    grid = tables(spark, sf_dir).transaction_grid
    return finish(explore.level_inventory(grid, ["level3"], ["level4", "style_color_group", "style_group"]))


@query("level_inventory_l3_l4", _inventory_sql(["level3", "level4"], ["style_color_group", "style_group"]))
def level_inventory_l3_l4(spark, sf_dir):
    grid = tables(spark, sf_dir).transaction_grid
    return finish(explore.level_inventory(grid, ["level3", "level4"], ["style_color_group", "style_group"]))


def _range_sql(key: str) -> str:
    return with_ctes(f"""SELECT {key}, CAST(count(transaction_date) AS BIGINT) AS n_rows, min(transaction_date) AS first_date,
                         max(transaction_date) AS last_date FROM grid WHERE {key} IS NOT NULL GROUP BY {key}""", *base("grid"))


@query("style_date_range", _range_sql("style_group"))
def style_date_range(spark, sf_dir):
    return finish(explore.date_range_by(tables(spark, sf_dir).transaction_grid, "style_group", "transaction_date"))


@query("colour_date_range", _range_sql("style_color_group"))
def colour_date_range(spark, sf_dir):
    return finish(explore.date_range_by(tables(spark, sf_dir).transaction_grid, "style_color_group", "transaction_date"))


def _profile_sql() -> str:
    parts = []
    for c in PROFILE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        z = f"(({x} - m.mu) / m.sd)"
        g1 = f"(count({x}) * 1.0 / ((count({x}) - 1) * (count({x}) - 2))) * sum(power({z}, 3))"
        k = f"CAST(count({x}) AS DOUBLE)"
        g2 = (f"({k} * ({k} + 1) / (({k} - 1) * ({k} - 2) * ({k} - 3))) * sum(power({z}, 4))"
              f" - 3 * power({k} - 1, 2) / (({k} - 2) * ({k} - 3))")
        parts.append(f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count({c}) AS BIGINT) AS missing,
            CAST(sum(CASE WHEN {x} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(count(DISTINCT {c}) AS BIGINT) AS "distinct",
            {r6(f'avg({x})')} AS mean, {r6(f'stddev_samp({x})')} AS std, {r6(f'min({x})')} AS min, {r6(f'max({x})')} AS max,
            {r6(f'sum(CASE WHEN {x} = 0 THEN 1 ELSE 0 END) / count(*)')} AS zero_share,
            {r6(f'CASE WHEN count({x}) > 2 THEN {g1} END')} AS skewness,
            {r6(f'CASE WHEN count({x}) > 3 THEN {g2} END')} AS kurtosis
            FROM grid, (SELECT avg({x}) AS mu, stddev_samp({x}) AS sd FROM grid) m""")
    return with_ctes(" UNION ALL ".join(parts), *base("grid"))


@query("table_profile", _profile_sql())
def table_profile(spark, sf_dir):
    return finish(explore.numeric_profile(tables(spark, sf_dir).transaction_grid, PROFILE_COLS))


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(PROFILE_COLS):
        for b in PROFILE_COLS[i + 1:]:
            xa, xb = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            parts.append(f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
                {r6(f'CASE WHEN count(*) > 1 AND var_pop({xa}) > 0 AND var_pop({xb}) > 0 THEN corr({xa}, {xb}) END')} AS corr FROM grid""")
    return with_ctes(" UNION ALL ".join(parts), *base("grid"))


@query("profile_correlations", _corr_sql())
def profile_correlations(spark, sf_dir):
    return finish(explore.pairwise_correlations(tables(spark, sf_dir).transaction_grid, PROFILE_COLS))


_SUMMARY_COLS = ["article_id", "price", "sales_channel_id"]


@query("table_summary", with_ctes(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, {r6(f'avg(CAST({c} AS DOUBLE))')} AS mean,
        {r6(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, {r6(f'min(CAST({c} AS DOUBLE))')} AS min,
        {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25, {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50,
        {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75,
        {r6(f'max(CAST({c} AS DOUBLE))')} AS max FROM transactions""" for c in _SUMMARY_COLS), *base("transactions")))
def table_summary(spark, sf_dir):
    return finish(explore.describe(tables(spark, sf_dir).transactions, _SUMMARY_COLS))


@query("date_range", with_ctes("SELECT min(t_dat) AS first_date, max(t_dat) AS last_date, "
                               "CAST(count(DISTINCT customer_id) AS BIGINT) AS n_customers FROM transactions",
                               *base("transactions")))
def date_range(spark, sf_dir):
    tx = tables(spark, sf_dir).transactions
    return finish(tx.agg(F.min("t_dat").alias("first_date"), F.max("t_dat").alias("last_date"),
                         F.countDistinct("customer_id").alias("n_customers")))


def _hist_sql(src_cte: tuple[str, str], value: str, bins: int = 100) -> list[tuple[str, str]]:
    return [src_cte,
            ("hs", f"SELECT min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi, count(*) AS n FROM hv WHERE {value} IS NOT NULL"),
            ("hg", f"""SELECT CAST(x AS DOUBLE) AS x, lo, hi, n, (hi - lo) / {bins} AS step,
                              CAST(coalesce(least({bins - 1}, floor((x - lo) / NULLIF((hi - lo) / {bins}, 0))), 0) AS INTEGER) AS j
                       FROM (SELECT CAST({value} AS DOUBLE) AS x FROM hv WHERE {value} IS NOT NULL), hs"""),
            ("hb", f"""SELECT CASE WHEN x < lo + j * step THEN j - 1
                                   WHEN j < {bins - 1} AND x >= lo + (j + 1) * step THEN j + 1 ELSE j END AS bin
                       FROM hg"""),
            ("hc", "SELECT bin, count(*) AS c FROM hb GROUP BY bin"),
            ("hist", f"""SELECT CAST(b.bin AS INTEGER) AS bin, {r6('hs.lo + b.bin * ((hs.hi - hs.lo) / %d)' % bins)} AS bin_left,
                                {r6('hs.lo + (b.bin + 1) * ((hs.hi - hs.lo) / %d)' % bins)} AS bin_right,
                                CAST(coalesce(hc.c, 0) AS BIGINT) AS count,
                                {r6('coalesce(hc.c, 0) / NULLIF(hs.n * ((hs.hi - hs.lo) / %d), 0)' % bins)} AS density
                         FROM hs, (SELECT unnest(range(0, {bins})) AS bin) b LEFT JOIN hc ON b.bin = hc.bin""")]


_ART_COUNTS = ("hv", "SELECT article_id, count(*) AS counts FROM transactions WHERE article_id IS NOT NULL GROUP BY article_id")


@query("count_histogram", with_ctes("SELECT * FROM hist", *base("transactions"), *_hist_sql(_ART_COUNTS, "counts")))
def count_histogram(spark, sf_dir):
    counts = prep.row_counts(tables(spark, sf_dir).transactions, "article_id")
    return finish(explore.histogram(counts, "counts"))


_PEN = ("hv", """SELECT article_id, nc / tot AS penetration FROM
    (SELECT article_id, count(DISTINCT customer_id) AS nc FROM tx WHERE article_id IS NOT NULL GROUP BY article_id),
    (SELECT count(DISTINCT customer_id) AS tot FROM tx)""")


@query("penetration_histogram", with_ctes("SELECT * FROM hist", *base("transactions"), tx_keyed(),
                                          *_hist_sql(_PEN, "penetration")))
def penetration_histogram(spark, sf_dir):
    pen = prep.penetration(prep.with_customer_key(tables(spark, sf_dir).transactions), "article_id")
    return finish(explore.histogram(pen, "penetration"))


@query("sales_ranking", with_ctes("""
SELECT article_id, CAST(count(*) AS BIGINT) AS counts,
       CAST(row_number() OVER (ORDER BY count(*) DESC, article_id) AS BIGINT) AS rank
FROM transactions WHERE article_id IS NOT NULL GROUP BY article_id""", *base("transactions")))
def sales_ranking(spark, sf_dir):
    return finish(explore.value_ranking(tables(spark, sf_dir).transactions, "article_id")
                  .withColumn("rank", F.col("rank").cast("bigint")))


@query("top_products", with_ctes(f"""
SELECT product_code, CAST(count(*) AS BIGINT) AS counts FROM txp WHERE product_code IS NOT NULL
GROUP BY product_code ORDER BY count(*) DESC, product_code LIMIT {TOP_K}""",
    *base("transactions", "articles"), tx_keyed(),
    ("txp", "SELECT t.*, a.product_code FROM tx t LEFT JOIN articles a ON t.article_id = a.article_id")))
def top_products(spark, sf_dir):
    t = tables(spark, sf_dir)
    df = t.transactions.join(t.articles.select("article_id", "product_code"), "article_id", "left")
    return finish(explore.top_k(df, "product_code", TOP_K))
