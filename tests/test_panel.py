import datetime as dt

from pyspark.sql import functions as F

from tillroll.operators import panel

D0 = dt.date(2021, 3, 1)


def series(spark, n, key="k", start=D0, step=1):
    rows = [(key, start + dt.timedelta(days=i * step), i + 1, float(100 + i)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, date date, y long, price double")


def test_temporal_split_days(spark):
    out = panel.temporal_split(series(spark, 20), "key", "date", 14).orderBy("date").collect()
    assert [r["split"] for r in out] == ["train"] * 6 + ["test"] * 14
    assert [r["day"] for r in out[6:]] == list(range(1, 15))
    assert all(r["day"] is None for r in out[:6])


def test_lag_table(spark):
    out = panel.lag_table(series(spark, 5), "key", "date", "y", 2).orderBy("date").collect()
    assert [(r["lag_1"], r["lag_2"]) for r in out] == [(None, None), (1, None), (2, 1), (3, 2), (4, 3)]


def test_horizon_table_direct_layout(spark):
    out = panel.horizon_table(series(spark, 10), "key", "date", "y", lags=3, horizon=2, exog=["price"])
    rows = {(r["origin_date"], r["h"]): r for r in out.collect()}
    r = rows[(D0 + dt.timedelta(days=2), 1)]       # origin is the 3rd row (y = 3)
    assert (r["lag_1"], r["lag_2"], r["lag_3"]) == (3, 2, 1)
    assert r["target"] == 4 and r["price"] == 103.0  # price of the target day
    assert rows[(D0 + dt.timedelta(days=2), 2)]["target"] == 5
    # first origin needs 3 lags; last origin needs a target 2 rows ahead
    assert min(k[0] for k in rows) == D0 + dt.timedelta(days=2)
    assert (D0 + dt.timedelta(days=8), 2) not in rows and (D0 + dt.timedelta(days=8), 1) in rows
    assert len(rows) == 2 * 6 + 1


def test_cv_folds(spark):
    out = panel.cv_folds(series(spark, 34), "key", "date", initial=30, window=15, horizon=1).collect()
    by_fold = {}
    for r in out:
        by_fold.setdefault(r["fold"], {}).setdefault(r["role"], []).append(r["t"])
    assert sorted(by_fold) == [0, 1, 2, 3]
    assert sorted(by_fold[0]["train"]) == list(range(1, 31)) and by_fold[0]["test"] == [31]
    assert sorted(by_fold[1]["train"]) == list(range(17, 32)) and by_fold[1]["test"] == [32]
    assert sorted(by_fold[3]["train"]) == list(range(19, 34)) and by_fold[3]["test"] == [34]


def test_gap_fill_and_weekly_zero_weeks(spark):
    df = series(spark, 3, step=10)            # days 0, 10, 20
    filled = panel.daily_sales(df.withColumnRenamed("date", "t_dat"), "key", "t_dat", "price", fill_gaps=True)
    rows = filled.orderBy("date").collect()
    assert len(rows) == 21 and sum(r["sales"] for r in rows) == 3
    assert rows[1]["sales"] == 0 and rows[1]["price"] is None


def test_daily_style_panel_means_and_sums(spark):
    grid = spark.createDataFrame(
        [("L3", "L4", "s", D0, 2, 10.0, 9.0, 1), ("L3", "L4", "s", D0, 3, 12.0, 12.0, 0)],
        "level3 string, level4 string, style_group string, transaction_date date, units_sold int, "
        "sales_price double, final_price double, is_promotion int")
    r = panel.daily_style_panel(grid).first()
    assert r["units_sold"] == 5 and r["sales_price"] == 11.0 and r["final_price"] == 10.5
    assert r["is_promotion"] == 0.5


def test_horizon_rows_are_made_of_rounded_prices_and_no_sales_are_summed(spark, sf_small, monkeypatch):
    """Prices are rounded a panel row, not in each of its horizon rows, and the
    statistics of a preparation without a sales share read no prices."""
    from tillroll.operators import prep
    from tillroll.plans import catalog
    summed, pairs = [], prep.customer_pairs
    monkeypatch.setattr(prep, "customer_pairs", lambda *a, **k: summed.append(k.get("value")) or pairs(*a, **k))
    out = catalog.queries()["horizon_table"](spark, sf_small)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert summed == [None] and "round(" not in above and "round(" in below
