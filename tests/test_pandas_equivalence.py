"""The Spark operators against their definitions and pandas versions of the
same procedures (sorted cumulative sums, resampling) on sf0.001."""

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from tillroll.operators import basket, prep
from tillroll.plans.registry import tables


def test_report_matches_its_definition(spark, sf_small):
    t = tables(spark, sf_small)
    rows = prep.prepare_basket_rows(t.transactions, t.articles)
    baskets = {}
    for r in rows.select("order_instance", "prod_name").collect():
        baskets.setdefault(r[0], Counter())[r[1]] += 1
    orders, together = Counter(), {}
    for basket_items in baskets.values():
        for item in basket_items:
            orders[item] += 1
            for partner, n in basket_items.items():
                if None not in (item, partner) and partner != item:
                    together.setdefault(item, Counter())[partner] += n
    got = {r["items"]: r for r in basket.co_purchase_report(rows, "prod_name", 3).collect()}
    assert set(got) == set(orders) - {None}
    for item, r in got.items():
        ranked = sorted(together.get(item, {}).items(), key=lambda p: (-p[1], p[0]))
        often = ranked[1:4]  # the first rank is skipped
        assert r["item_order_cnt"] == orders[item]
        assert r["often_purchased"] == [p for p, _ in often]
        assert r["rare_purchased"] == [p for p, _ in reversed(ranked[-3:])]
        assert abs(r["support"] - orders[item] / len(baskets)) < 1e-12
        assert [r[f"{k}_freq_confidence"] for k in range(1, len(often) + 1)] == [n / orders[item] for _, n in often]


def test_forecast_prep_matches_pandas(spark, sf_small):
    t = tables(spark, sf_small)
    pen, frac = 0.2, 0.6
    tx = prep.with_customer_key(t.transactions).join(
        t.articles.select("article_id", "product_code", "prod_name"), "article_id", "left").toPandas()
    custn = tx.groupby("product_code")["customer_id"].nunique() / tx["customer_id"].nunique()
    df = tx[tx.product_code.isin(custn[custn >= pen].index)]
    sales = df.groupby("product_code")["price"].sum().reset_index()
    sales = sales.sort_values(["price", "product_code"], ascending=[False, True])
    sales["share"] = sales["price"].cumsum() / sales["price"].sum()
    want = set(sales.loc[sales.share <= frac, "product_code"])
    got = prep.prepare_forecast_rows(t.transactions, t.articles, frac, pen)
    assert set(r[0] for r in got.select("product_code").distinct().collect()) == want
    assert got.count() == len(df[df.product_code.isin(want)])


def test_weekly_resample_matches_pandas(spark, sf_small):
    from tillroll.operators import panel
    from tillroll.plans.panel_queries import name_daily
    daily = name_daily(spark, sf_small)
    got = {(r["prod_name"], r["week_end"]): r["sales"]
           for r in panel.weekly_sales(daily, "prod_name", "date", "sales").collect()}
    pdf = daily.toPandas()
    pdf["date"] = pd.to_datetime(pdf["date"])
    want = {}
    for name, g in pdf.groupby("prod_name"):
        w = g.set_index("date")["sales"].resample("W").sum()
        want.update({(name, d.date()): int(v) for d, v in w.items()})
    assert got == want


def test_date_features_match_pandas_accessors(spark, sf_small):
    from tillroll.operators import features
    from tillroll.plans.panel_queries import product_daily
    got = features.product_features(product_daily(spark, sf_small)).toPandas()
    d = pd.to_datetime(got["date"]).dt
    expect = {
        "Year": d.year, "Week": d.isocalendar().week.astype("int64"), "Day": d.day, "Dayofyear": d.dayofyear,
        "Is_month_end": d.is_month_end.astype(int), "Is_month_start": d.is_month_start.astype(int),
        "Is_quarter_end": d.is_quarter_end.astype(int), "Is_quarter_start": d.is_quarter_start.astype(int),
        "Is_year_end": d.is_year_end.astype(int), "Is_year_start": d.is_year_start.astype(int),
    }
    for col, want in expect.items():
        assert (got[col].astype("int64").to_numpy() == want.astype("int64").to_numpy()).all(), col
    for k in range(7):
        assert (got[f"Dayofweek_{k}"].to_numpy() == (d.dayofweek == k).astype(int).to_numpy()).all()
    for k in range(1, 13):
        assert (got[f"Month_{k}"].to_numpy() == (d.month == k).astype(int).to_numpy()).all()
