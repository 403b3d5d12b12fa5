"""Registered queries: preparation, eligibility and co-purchase reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.keys import hex_tail_to_long, order_instance
from tillroll.operators import basket, prep
from tillroll.plans.registry import finish, query, tables
from tillroll.plans.sqlparts import (base, basket_report_sql, basket_stages, hex_key,
                                     prepared_basket, relative_keep, tx_keyed, with_ctes)

# Parameters of the query set (fixed so both engines compute the same thing).
# In the test tables rows and customers per part stay constant while the
# number of customers grows with the scale factor, so a fixed penetration
# that splits the articles at one scale removes all of them at the next.  The
# thresholds are therefore given in units of the mean penetration, and the
# reports run over all items (penetration 0, "no filter").
RELATIVE_PENETRATION = 1.1         # prepared_rows / eligibility queries
REPORT_PENETRATION = 0.0           # co-purchase reports: every item
BASKET_N = 3
LIST_ITEMS = ["red widget", "small ring", "blue bolt", "hot gear"]
FORECAST_PENETRATION = 0.5         # forecasting: times the mean penetration
SHARE_FRACTION = 0.5
LIFESPAN_FIRST_BY = "1995-01-10"
LIFESPAN_LAST_FROM = "2001-07-20"
MIN_CNT = 30


def _prepared(spark, sf_dir, relative: float = 0.0):
    t = tables(spark, sf_dir)
    return prep.prepare_basket_rows(t.transactions, t.articles, REPORT_PENETRATION, relative_penetration=relative)


@query("prepared_rows", with_ctes(
    "SELECT * FROM prepared",
    *base("transactions", "articles"), *prepared_basket(relative=RELATIVE_PENETRATION)))
def prepared_rows(spark, sf_dir):
    return finish(_prepared(spark, sf_dir, RELATIVE_PENETRATION))


@query("co_purchase_report", basket_report_sql("prod_name", BASKET_N, penetration=REPORT_PENETRATION))
def co_purchase_report(spark, sf_dir):
    return finish(basket.co_purchase_report(_prepared(spark, sf_dir), "prod_name", BASKET_N))


@query("co_purchase_by_type", basket_report_sql("product_type_name", 2, penetration=REPORT_PENETRATION))
def co_purchase_by_type(spark, sf_dir):
    return finish(basket.co_purchase_report(_prepared(spark, sf_dir), "product_type_name", 2))


@query("co_purchase_by_article", basket_report_sql("article_id", BASKET_N, penetration=REPORT_PENETRATION))
def co_purchase_by_article(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    return finish(basket.co_purchase_report(rows, "article_id", BASKET_N)
                  .withColumn("items", F.col("items").cast("string"))
                  .withColumn("often_purchased", F.transform("often_purchased", lambda x: x.cast("string")))
                  .withColumn("rare_purchased", F.transform("rare_purchased", lambda x: x.cast("string"))))


@query("co_purchase_for_list", basket_report_sql("prod_name", BASKET_N, penetration=REPORT_PENETRATION,
                                                 prods=LIST_ITEMS))
def co_purchase_for_list(spark, sf_dir):
    return finish(basket.co_purchase_report(_prepared(spark, sf_dir), "prod_name", BASKET_N,
                                            prods=LIST_ITEMS))


def _detail_sql(n: int, names: list[str] | None = None) -> str:
    skip = 1
    ctes = (base("transactions", "articles") + prepared_basket(REPORT_PENETRATION)
            + basket_stages("prod_name") + [
                ("support_t", "SELECT io.item, io.item_order_cnt, io.item_order_cnt / n.n_order AS support FROM item_orders io CROSS JOIN n_orders n"),
                ("meta", """SELECT prod_name, min(product_group_name) AS g, min(product_type_name) AS t
                            FROM articles WHERE prod_name IS NOT NULL GROUP BY prod_name"""),
                ("often", f"""SELECT r.item, r.rn_often - {skip} AS k, r.partner, r.pair_cnt,
                                     (r.pair_cnt / n.n_order) / (sp.support * si.support) AS lift,
                                     m.g, m.t, r.pair_cnt / si.item_order_cnt AS conf
                              FROM ranked r CROSS JOIN n_orders n
                              JOIN support_t si ON r.item = si.item
                              LEFT JOIN support_t sp ON r.partner = sp.item
                              LEFT JOIN meta m ON r.partner = m.prod_name
                              WHERE r.rn_often > {skip} AND r.rn_often <= {skip + n}"""),
                ("often_agg", "SELECT item, string_agg(partner, '|' ORDER BY k) AS often_purchased, "
                              "string_agg(g, '|' ORDER BY k) AS often_purchased_group, "
                              "string_agg(t, '|' ORDER BY k) AS often_purchased_prod_types, "
                              + ", ".join(f"max(CASE WHEN k = {k} THEN conf END) AS c{k}, "
                                          f"max(CASE WHEN k = {k} THEN lift END) AS l{k}" for k in range(1, n + 1))
                              + " FROM often GROUP BY item"),
                ("rare", f"SELECT item, string_agg(partner, '|' ORDER BY rn_rare) AS rare_purchased FROM ranked WHERE rn_rare <= {n} GROUP BY item"),
                ("dim", "SELECT DISTINCT prod_name, product_type_name, product_group_name FROM articles WHERE prod_name IS NOT NULL"),
            ])
    cols = ", ".join([f'CAST(round(CAST(o.c{k} AS DECIMAL(38,10)), 6) AS DOUBLE) AS "{k}_freq_confidence"' for k in range(1, n + 1)]
                     + ["CAST(round(CAST(s.support AS DECIMAL(38,10)), 6) AS DOUBLE) AS support"]
                     + [f'CAST(round(CAST(o.l{k} AS DECIMAL(38,10)), 6) AS DOUBLE) AS "{k}_freq_prod_lift"' for k in range(1, n + 1)])
    body = f"""
SELECT s.item AS prod_name, CAST(s.item_order_cnt AS BIGINT) AS item_order_cnt,
       coalesce(o.often_purchased, '') AS often_purchased, coalesce(r.rare_purchased, '') AS rare_purchased,
       d.product_type_name, d.product_group_name, {cols},
       coalesce(o.often_purchased_group, '') AS often_purchased_group,
       coalesce(o.often_purchased_prod_types, '') AS often_purchased_prod_types
FROM support_t s LEFT JOIN often_agg o ON s.item = o.item LEFT JOIN rare r ON s.item = r.item
LEFT JOIN dim d ON s.item = d.prod_name"""
    if names is not None:
        body += " WHERE s.item IN (" + ", ".join("'" + x.replace("'", "''") + "'" for x in names) + ")"
    return with_ctes(body, *ctes)


@query("co_purchase_detail", _detail_sql(BASKET_N))
def co_purchase_detail(spark, sf_dir):
    t = tables(spark, sf_dir)
    return finish(basket.co_purchase_detail(_prepared(spark, sf_dir), t.articles, BASKET_N))


SINGLE_ITEM = ["red widget"]


@query("co_purchase_detail_item", _detail_sql(BASKET_N, SINGLE_ITEM))
def co_purchase_detail_item(spark, sf_dir):
    """R4 for one named item (the single-item report): the name filter is
    applied to the left side of the pair self-join."""
    t = tables(spark, sf_dir)
    return finish(basket.co_purchase_detail(_prepared(spark, sf_dir), t.articles, BASKET_N, names=SINGLE_ITEM))


def _pairs_sql(select: str) -> str:
    ctes = (base("transactions", "articles") + prepared_basket(REPORT_PENETRATION)
            + basket_stages("prod_name")
            + [("support_t", "SELECT io.item, io.item_order_cnt, io.item_order_cnt / n.n_order AS support FROM item_orders io CROSS JOIN n_orders n")])
    return with_ctes(select, *ctes)


@query("item_support", _pairs_sql(
    "SELECT item AS prod_name, CAST(item_order_cnt AS BIGINT) AS item_order_cnt, CAST(round(CAST(support AS DECIMAL(38,10)), 6) AS DOUBLE) AS support FROM support_t"))
def item_support(spark, sf_dir):
    return finish(basket.item_support(_prepared(spark, sf_dir), "prod_name"))


@query("pair_counts", _pairs_sql("SELECT item, partner, pair_cnt FROM pairs"))
def pair_counts(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    return finish(basket.pair_counts(basket.basket_cells(rows, "prod_name"), "prod_name"))


_PAIR_METRICS = """
SELECT p.item, p.partner, p.pair_cnt, CAST(round(CAST(p.pair_cnt / a.item_order_cnt AS DECIMAL(38,10)), 6) AS DOUBLE) AS confidence,
       CAST(round(CAST((p.pair_cnt / n.n_order) / (a.support * b.support) AS DECIMAL(38,10)), 6) AS DOUBLE) AS lift
FROM pairs p JOIN support_t a ON p.item = a.item JOIN support_t b ON p.partner = b.item CROSS JOIN n_orders n"""


@query("pair_confidence", _pairs_sql(f"SELECT item, partner, confidence FROM ({_PAIR_METRICS})"))
def pair_confidence(spark, sf_dir):
    return finish(basket.pair_metrics(_prepared(spark, sf_dir), "prod_name")
                  .select("item", "partner", "confidence"))


@query("pair_lift", _pairs_sql(f"SELECT item, partner, pair_cnt, lift FROM ({_PAIR_METRICS})"))
def pair_lift(spark, sf_dir):
    return finish(basket.pair_metrics(_prepared(spark, sf_dir), "prod_name")
                  .select("item", "partner", "pair_cnt", "lift"))


@query("partner_tops", _pairs_sql(f"""
SELECT item, kind, CAST(rank AS BIGINT) AS rank, partner, pair_cnt, confidence, lift FROM (
    SELECT m.*, k.kind, row_number() OVER (PARTITION BY m.item, k.kind ORDER BY
               CASE k.kind WHEN 'often' THEN -CAST(m.pair_cnt AS DOUBLE) WHEN 'rare' THEN CAST(m.pair_cnt AS DOUBLE)
                           ELSE -CAST(m.pair_cnt AS DOUBLE) / CAST(c.item_order_cnt AS DOUBLE) END,
               CASE WHEN k.kind <> 'rare' THEN m.partner END, CASE WHEN k.kind = 'rare' THEN m.partner END DESC) AS rank
    FROM ({_PAIR_METRICS}) m JOIN item_orders c ON m.partner = c.item
         CROSS JOIN (SELECT unnest(['often', 'rare', 'lift']) AS kind) k)
WHERE rank <= {BASKET_N}"""))
def partner_tops(spark, sf_dir):
    return finish(basket.partner_tops(_prepared(spark, sf_dir), "prod_name", BASKET_N))


@query("often_partners", _pairs_sql(
    f"SELECT item, rn_often - 1 AS rank, partner, pair_cnt FROM ranked WHERE rn_often > 1 AND rn_often <= {BASKET_N + 1}"))
def often_partners(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    pairs = basket.pair_counts(basket.basket_cells(rows, "prod_name"), "prod_name")
    return finish(basket.ranked_partners(pairs, BASKET_N).where(F.col("kind") == "often")
                  .select("item", F.col("rank").cast("bigint").alias("rank"), "partner", "pair_cnt"))


@query("rare_partners", _pairs_sql(
    f"SELECT item, rn_rare AS rank, partner, pair_cnt FROM ranked WHERE rn_rare <= {BASKET_N}"))
def rare_partners(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    pairs = basket.pair_counts(basket.basket_cells(rows, "prod_name"), "prod_name")
    return finish(basket.ranked_partners(pairs, BASKET_N).where(F.col("kind") == "rare")
                  .select("item", F.col("rank").cast("bigint").alias("rank"), "partner", "pair_cnt"))


# ---- eligibility -----------------------------------------------------------

_TX = base("transactions", "articles") + [tx_keyed()]


@query("penetration", with_ctes("""
SELECT article_id, CAST(nc AS BIGINT) AS n_customers, CAST(round(CAST(nc / tot AS DECIMAL(38,10)), 6) AS DOUBLE) AS penetration
FROM (SELECT article_id, count(DISTINCT customer_id) AS nc FROM tx WHERE article_id IS NOT NULL GROUP BY article_id),
     (SELECT count(DISTINCT customer_id) AS tot FROM tx)""", *_TX))
def penetration_q(spark, sf_dir):
    t = tables(spark, sf_dir)
    return finish(prep.penetration(prep.with_customer_key(t.transactions), "article_id"))


@query("eligible_articles", with_ctes(relative_keep("article_id", "tx", RELATIVE_PENETRATION), *_TX))
def eligible_articles(spark, sf_dir):
    t = tables(spark, sf_dir)
    return finish(prep.eligible_by_relative_penetration(prep.with_customer_key(t.transactions), "article_id",
                                                        RELATIVE_PENETRATION))


_TXP = _TX + [("txp", "SELECT t.*, a.product_code, a.prod_name FROM tx t LEFT JOIN articles a ON t.article_id = a.article_id")]


@query("eligible_products", with_ctes(relative_keep("product_code", "txp", 1.0), *_TXP))
def eligible_products(spark, sf_dir):
    t = tables(spark, sf_dir)
    df = prep.with_customer_key(t.transactions).join(
        t.articles.select("article_id", "product_code", "prod_name"), "article_id", "left")
    return finish(prep.eligible_by_relative_penetration(df, "product_code", 1.0))


@query("min_count_articles", with_ctes(f"""
SELECT article_id, CAST(count(*) AS BIGINT) AS counts FROM tx WHERE article_id IS NOT NULL
GROUP BY article_id HAVING count(*) >= {MIN_CNT}""", *_TX))
def min_count_articles(spark, sf_dir):
    t = tables(spark, sf_dir)
    return finish(prep.row_counts(t.transactions, "article_id").where(F.col("counts") >= MIN_CNT))


@query("eligible_counts", with_ctes(f"""
SELECT CAST(count(DISTINCT article_id) AS BIGINT) AS n_eligible FROM tx
WHERE article_id IN ({relative_keep("article_id", "tx", RELATIVE_PENETRATION)})
  AND article_id IN (SELECT article_id FROM tx GROUP BY article_id HAVING count(*) >= {MIN_CNT})""", *_TX))
def eligible_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    rows = prep.prepare_basket_rows(t.transactions, t.articles, 0.0, MIN_CNT, relative_penetration=RELATIVE_PENETRATION)
    return finish(prep.eligible_counts(rows, "article_id"))


@query("customer_key", with_ctes(f"""
SELECT DISTINCT customer_id AS customer_hex, {hex_key('customer_id')} AS customer_id FROM transactions""",
                                 *base("transactions")))
def customer_key(spark, sf_dir):
    t = tables(spark, sf_dir)
    return finish(t.transactions.select(F.col("customer_id").alias("customer_hex"),
                                        hex_tail_to_long("customer_id").alias("customer_id")).distinct())


@query("order_instances", with_ctes("""
SELECT order_instance, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT article_id) AS BIGINT) AS n_articles
FROM (SELECT CAST(customer_id AS VARCHAR) || strftime(t_dat, '%Y-%m-%d') AS order_instance, article_id FROM tx)
GROUP BY order_instance""", *_TX))
def order_instances(spark, sf_dir):
    t = tables(spark, sf_dir)
    tx = prep.with_customer_key(t.transactions)
    return finish(tx.groupBy(order_instance("customer_id", "t_dat").alias("order_instance"))
                  .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("article_id").alias("n_articles")))
