"""Registered queries: forecast preparation, panels, features, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.calendar import fourier_coefficient
from tillroll.operators import features, panel, prep
from tillroll.operators.calendar_dim import with_holiday_flag
from tillroll.plans.basket_queries import (FORECAST_PENETRATION, LIFESPAN_FIRST_BY,
                                           LIFESPAN_LAST_FROM, SHARE_FRACTION)
from tillroll.plans.registry import finish, query, tables
from tillroll.plans.sqlparts import base, relative_keep, tx_keyed, with_ctes

LAGS = 30
HORIZON = 14

# ---- SQL building blocks ---------------------------------------------------

_TXP = [tx_keyed(), ("txp", "SELECT t.*, a.product_code, a.prod_name FROM tx t LEFT JOIN articles a ON t.article_id = a.article_id")]
_PEN = [("pen_keep", relative_keep("product_code", "txp", FORECAST_PENETRATION)),
        ("pen_rows", "SELECT * FROM txp WHERE product_code IN (SELECT product_code FROM pen_keep)")]


def _share_cte(src: str) -> tuple[str, str]:
    return ("share", f"""
SELECT product_code, total_sales,
       CAST(sum(total_sales) OVER (ORDER BY total_sales DESC, product_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
       / CAST(sum(total_sales) OVER () AS DOUBLE) AS cum_share
FROM (SELECT product_code, sum(CAST(price AS DECIMAL(18,4))) AS total_sales FROM {src}
      WHERE product_code IS NOT NULL GROUP BY product_code)""")


def _decile_sql(x: str = "cum_share") -> str:
    parts = " + ".join(f"CAST({x} > {i} * ((hi - lo) / 10) + lo AS INTEGER)" for i in range(1, 10))
    return f"CAST(1 + {parts} AS INTEGER)"


_SHARE_DECILE = ("share_d", f"""SELECT s.*, {_decile_sql()} AS decile FROM share s,
                  (SELECT min(cum_share) AS lo, max(cum_share) AS hi FROM share) b""")
_LONG = [("long_keep", f"""SELECT product_code FROM pen_rows WHERE product_code IS NOT NULL GROUP BY product_code
                         HAVING min(t_dat) <= DATE '{LIFESPAN_FIRST_BY}' AND max(t_dat) >= DATE '{LIFESPAN_LAST_FROM}'"""),
         ("fc_rows", "SELECT * FROM pen_rows WHERE product_code IN (SELECT product_code FROM long_keep)"),
         ("daily", """SELECT product_code, t_dat AS date, count(*) AS sales, avg(CAST(price AS DECIMAL(18,4))) AS price
                      FROM fc_rows GROUP BY product_code, t_dat""")]
_FC = base("transactions", "articles") + _TXP + _PEN + _LONG

_NAME_DAILY = base("transactions", "articles") + _TXP + [
    ("nd", """SELECT prod_name, t_dat AS date, count(*) AS sales FROM txp WHERE prod_name IS NOT NULL
              GROUP BY prod_name, t_dat""")]

_STYLE = base("grid", "holidays") + [("sp", """
SELECT level3, level4, style_group, transaction_date,
       coalesce(avg(sales_price), 0) AS sales_price, coalesce(avg(final_price), 0) AS final_price,
       coalesce(avg(is_promotion), 0) AS is_promotion, coalesce(sum(units_sold), 0) AS units_sold
FROM grid WHERE style_group IS NOT NULL AND transaction_date IS NOT NULL
GROUP BY level3, level4, style_group, transaction_date""")]


# ---- Spark helpers -----------------------------------------------------------

def _txp(spark, sf_dir):
    t = tables(spark, sf_dir)
    return prep.with_customer_key(t.transactions).select("t_dat", "customer_id", "article_id", "price") \
        .join(t.articles.select("article_id", "product_code", "prod_name"), "article_id", "left")


def _forecast_rows(spark, sf_dir, fraction: float = 0.0):
    t = tables(spark, sf_dir)
    return prep.prepare_forecast_rows(t.transactions, t.articles, fraction, relative_penetration=FORECAST_PENETRATION)


def _long_lived_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    return prep.prepare_forecast_rows(t.transactions, t.articles, relative_penetration=FORECAST_PENETRATION,
                                      first_by=LIFESPAN_FIRST_BY, last_from=LIFESPAN_LAST_FROM)


def product_daily(spark, sf_dir):
    rows = _long_lived_rows(spark, sf_dir).withColumn("price", F.col("price").cast("decimal(18,4)"))
    return panel.daily_sales(rows, "product_code", "t_dat", "price")


def name_daily(spark, sf_dir):
    rows = _txp(spark, sf_dir)
    return (rows.where(F.col("prod_name").isNotNull())
                .groupBy("prod_name", F.col("t_dat").alias("date")).agg(F.count(F.lit(1)).alias("sales")))


def style_panel(spark, sf_dir):
    return panel.daily_style_panel(tables(spark, sf_dir).transaction_grid)


# ---- forecast preparation ----------------------------------------------------

@query("prepared_forecast_rows", with_ctes(
    f"""SELECT t_dat, customer_id, article_id, price, product_code, prod_name FROM pen_rows
        WHERE product_code IN (SELECT product_code FROM share WHERE cum_share <= {SHARE_FRACTION})""",
    *base("transactions", "articles"), *_TXP, *_PEN, _share_cte("pen_rows")))
def prepared_forecast_rows(spark, sf_dir):
    return finish(_forecast_rows(spark, sf_dir, SHARE_FRACTION))


@query("product_revenue", with_ctes(
    "SELECT product_code, CAST(CAST(round(CAST(sum(CAST(price AS DECIMAL(18,4))) AS DECIMAL(38,10)), 6) AS DOUBLE) AS DOUBLE) AS total_sales FROM txp "
    "WHERE product_code IS NOT NULL GROUP BY product_code", *base("transactions", "articles"), *_TXP))
def product_revenue(spark, sf_dir):
    rows = _txp(spark, sf_dir)
    return finish(rows.where(F.col("product_code").isNotNull()).groupBy("product_code")
                  .agg(F.sum(F.col("price").cast("decimal(18,4)")).alias("total_sales")))


@query("product_lifespan", with_ctes(
    "SELECT product_code, min(t_dat) AS min_date, max(t_dat) AS max_date FROM txp "
    "WHERE product_code IS NOT NULL GROUP BY product_code", *base("transactions", "articles"), *_TXP))
def product_lifespan(spark, sf_dir):
    return finish(prep.lifespan(_txp(spark, sf_dir)))


@query("sales_share", with_ctes(
    "SELECT product_code, CAST(CAST(round(CAST(total_sales AS DECIMAL(38,10)), 6) AS DOUBLE) AS DOUBLE) AS total_sales, CAST(round(CAST(cum_share AS DECIMAL(38,10)), 6) AS DOUBLE) AS cum_share, decile FROM share_d",
    *base("transactions", "articles"), *_TXP, _share_cte("txp"), _SHARE_DECILE))
def sales_share(spark, sf_dir):
    return finish(prep.sales_share(_txp(spark, sf_dir)))


@query("sales_deciles", with_ctes(
    "SELECT product_code, decile FROM share_d WHERE decile < 3",
    *base("transactions", "articles"), *_TXP, _share_cte("txp"), _SHARE_DECILE))
def sales_deciles(spark, sf_dir):
    return finish(prep.sales_share(_txp(spark, sf_dir)).where(F.col("decile") < 3)
                  .select("product_code", "decile"))


@query("top_share_products", with_ctes(
    f"SELECT product_code FROM share WHERE cum_share <= {SHARE_FRACTION}",
    *base("transactions", "articles"), *_TXP, _share_cte("txp")))
def top_share_products(spark, sf_dir):
    return finish(prep.top_share_keys(_txp(spark, sf_dir), SHARE_FRACTION))


@query("long_lived_products", with_ctes("SELECT product_code FROM long_keep", *_FC))
def long_lived_products(spark, sf_dir):
    return finish(prep.long_lived_keys(_forecast_rows(spark, sf_dir), LIFESPAN_FIRST_BY, LIFESPAN_LAST_FROM))


# ---- panels -------------------------------------------------------------------

@query("daily_product_sales", with_ctes(
    "SELECT product_code, date, CAST(sales AS BIGINT) AS sales, CAST(round(CAST(price AS DECIMAL(38,10)), 6) AS DOUBLE) AS price FROM daily", *_FC))
def daily_product_sales(spark, sf_dir):
    return finish(product_daily(spark, sf_dir))


@query("daily_style_panel", with_ctes(
    "SELECT level3, level4, style_group, transaction_date, CAST(round(CAST(sales_price AS DECIMAL(38,10)), 6) AS DOUBLE) AS sales_price, "
    "CAST(round(CAST(final_price AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_price, CAST(round(CAST(is_promotion AS DECIMAL(38,10)), 6) AS DOUBLE) AS is_promotion, CAST(units_sold AS BIGINT) AS units_sold FROM sp",
    *_STYLE))
def daily_style_panel(spark, sf_dir):
    return finish(style_panel(spark, sf_dir))


@query("weekly_sales", with_ctes("""
SELECT c.prod_name, c.week_end, CAST(coalesce(w.sales, 0) AS BIGINT) AS sales
FROM (SELECT prod_name, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
      FROM (SELECT prod_name, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_end FROM nd) GROUP BY prod_name) c
LEFT JOIN (SELECT prod_name, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_end, sum(sales) AS sales
           FROM nd GROUP BY ALL) w ON c.prod_name = w.prod_name AND c.week_end = w.week_end""", *_NAME_DAILY))
def weekly_sales(spark, sf_dir):
    return finish(panel.weekly_sales(name_daily(spark, sf_dir), "prod_name", "date", "sales"))


@query("daily_gap_filled", with_ctes("""
SELECT c.product_code, c.date, CAST(coalesce(d.sales, 0) AS BIGINT) AS sales, CAST(round(CAST(d.price AS DECIMAL(38,10)), 6) AS DOUBLE) AS price
FROM (SELECT product_code, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
      FROM daily GROUP BY product_code) c
LEFT JOIN daily d ON c.product_code = d.product_code AND c.date = d.date""", *_FC))
def daily_gap_filled(spark, sf_dir):
    rows = _long_lived_rows(spark, sf_dir).withColumn("price", F.col("price").cast("decimal(18,4)"))
    return finish(panel.daily_sales(rows, "product_code", "t_dat", "price", fill_gaps=True))


# ---- features -------------------------------------------------------------------

def _date_parts_sql(d: str, prefix: str = "") -> dict[str, str]:
    qs = f"CAST(date_trunc('quarter', {d}) AS DATE)"
    return {
        f"{prefix}Year": f"CAST(year({d}) AS INTEGER)",
        f"{prefix}Month": f"CAST(month({d}) AS INTEGER)",
        f"{prefix}Week": f"CAST(week({d}) AS INTEGER)",
        f"{prefix}Day": f"CAST(day({d}) AS INTEGER)",
        f"{prefix}Dayofweek": f"CAST(isodow({d}) - 1 AS INTEGER)",
        f"{prefix}Dayofyear": f"CAST(dayofyear({d}) AS INTEGER)",
        f"{prefix}Is_month_end": f"CAST({d} = last_day({d}) AS INTEGER)",
        f"{prefix}Is_month_start": f"CAST(day({d}) = 1 AS INTEGER)",
        f"{prefix}Is_quarter_end": f"CAST({d} = last_day({qs} + INTERVAL 2 MONTH) AS INTEGER)",
        f"{prefix}Is_quarter_start": f"CAST({d} = {qs} AS INTEGER)",
        f"{prefix}Is_year_end": f"CAST(month({d}) = 12 AND day({d}) = 31 AS INTEGER)",
        f"{prefix}Is_year_start": f"CAST(month({d}) = 1 AND day({d}) = 1 AS INTEGER)",
    }


def _product_features_sql(src: str = "daily", extra: str = "", ctes=None) -> str:
    m = _date_parts_sql("date")
    m["price"] = "CAST(round(CAST(price AS DECIMAL(38,10)), 6) AS DOUBLE)"
    for k in range(7):
        m[f"Dayofweek_{k}"] = f"CAST(isodow(date) - 1 = {k} AS INTEGER)"
    for k in range(1, 13):
        m[f"Month_{k}"] = f"CAST(month(date) = {k} AS INTEGER)"
    cols = ", ".join(f'{m[n]} AS "{n}"' for n in features.PRODUCT_FEATURES)
    return with_ctes(f"SELECT product_code, date, CAST(sales AS BIGINT) AS sales, {cols}{extra} FROM {src}",
                     *(ctes or _FC))


@query("date_features", _product_features_sql())
def date_features(spark, sf_dir):
    return finish(features.product_features(product_daily(spark, sf_dir)))


def _fourier_sql(t: str, freq: int = 4, order: int = 4) -> dict[str, str]:
    out = {}
    for i in range(1, order + 1):
        c = repr(fourier_coefficient(freq, i))
        out[f"sin_{freq}_{i}"] = f"(CAST(round(CAST(sin(CAST({t} AS DOUBLE) * {c}) AS DECIMAL(38,10)), 6) AS DOUBLE) + 0.0)"
        out[f"cos_{freq}_{i}"] = f"(CAST(round(CAST(cos(CAST({t} AS DOUBLE) * {c}) AS DECIMAL(38,10)), 6) AS DOUBLE) + 0.0)"
    return out


_WIN = "OVER (PARTITION BY style_group ORDER BY transaction_date"


def _style_features_sql() -> str:
    d = "transaction_date"
    m = _date_parts_sql(d, "transaction_")
    m["transaction_Year"] = f"CASE WHEN year({d}) = 2022 THEN 0 ELSE 1 END"
    m.update(_fourier_sql("t0"))
    m["trend"] = "CAST(t0 + 1 AS INTEGER)"
    m["MA"] = "CAST(round(CAST(ma AS DECIMAL(38,10)), 6) AS DOUBLE)"
    m["final_price"] = "CAST(round(CAST(final_price AS DECIMAL(38,10)), 6) AS DOUBLE)"
    m["is_promotion"] = "CAST(round(CAST(is_promotion AS DECIMAL(38,10)), 6) AS DOUBLE)"
    m["holiday_flag"] = "holiday_flag"
    for k in range(1, 13):
        m[f"transaction_Month_{k}"] = f"CAST(month({d}) = {k} AS INTEGER)"
    for k in range(7):
        m[f"transaction_Dayofweek_{k}"] = f"CAST(isodow({d}) - 1 = {k} AS INTEGER)"
    cols = ", ".join(f'{m[n]} AS "{n}"' for n in features.STYLE_FEATURES)
    body = f"""
SELECT style_group, transaction_date, CAST(units_sold AS BIGINT) AS units_sold, {cols}
FROM (SELECT sp.*, CAST(h.holiday_date IS NOT NULL AS INTEGER) AS holiday_flag,
             row_number() {_WIN}) - 1 AS t0,
             CASE WHEN count(units_sold) {_WIN} ROWS BETWEEN 26 PRECEDING AND 25 FOLLOWING) >= 26
                  THEN avg(units_sold) {_WIN} ROWS BETWEEN 26 PRECEDING AND 25 FOLLOWING) END AS ma
      FROM sp LEFT JOIN (SELECT DISTINCT holiday_date FROM holidays) h ON sp.transaction_date = h.holiday_date)"""
    return with_ctes(body, *_STYLE)


@query("extended_features", _style_features_sql())
def extended_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    return finish(features.style_features(style_panel(spark, sf_dir), t.holidays))


@query("fourier_features", with_ctes(
    "SELECT style_group, transaction_date, " + ", ".join(f"{v} AS {k}" for k, v in _fourier_sql("t0").items())
    + f" FROM (SELECT style_group, transaction_date, row_number() {_WIN}) - 1 AS t0 FROM sp)", *_STYLE))
def fourier_features(spark, sf_dir):
    from pyspark.sql import Window
    from tillroll.functions.calendar import fourier_columns
    sp = style_panel(spark, sf_dir)
    t0 = F.row_number().over(Window.partitionBy("style_group").orderBy("transaction_date")) - 1
    return finish(sp.select("style_group", "transaction_date", *fourier_columns(t0, 4, 4)))


@query("centred_ma", with_ctes(f"""
SELECT style_group, transaction_date,
       round(CASE WHEN count(units_sold) {_WIN} ROWS BETWEEN 26 PRECEDING AND 25 FOLLOWING) >= 26
                  THEN avg(units_sold) {_WIN} ROWS BETWEEN 26 PRECEDING AND 25 FOLLOWING) END, 6) AS MA,
       round(CASE WHEN count(units_sold) {_WIN} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) >= 26
                  THEN avg(units_sold) {_WIN} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) END, 6) AS MA_trailing
FROM sp""", *_STYLE))
def centred_ma(spark, sf_dir):
    sp = style_panel(spark, sf_dir)
    return finish(sp.select(
        "style_group", "transaction_date",
        features.centred_moving_average("units_sold", "style_group", "transaction_date").alias("MA"),
        features.trailing_moving_average("units_sold", "style_group", "transaction_date").alias("MA_trailing")))


@query("trend_index", with_ctes(
    f"SELECT style_group, transaction_date, CAST(row_number() {_WIN}) AS INTEGER) AS trend FROM sp", *_STYLE))
def trend_index(spark, sf_dir):
    sp = style_panel(spark, sf_dir)
    return finish(sp.select("style_group", "transaction_date",
                            features.trend_index("style_group", "transaction_date").alias("trend")))


@query("holiday_flags", with_ctes("""
SELECT DISTINCT sp.transaction_date, CAST(h.holiday_date IS NOT NULL AS INTEGER) AS holiday_flag
FROM sp LEFT JOIN (SELECT DISTINCT holiday_date FROM holidays) h ON sp.transaction_date = h.holiday_date""", *_STYLE))
def holiday_flags(spark, sf_dir):
    t = tables(spark, sf_dir)
    days = style_panel(spark, sf_dir).select("transaction_date").distinct()
    return finish(with_holiday_flag(days, "transaction_date", t.holidays))


# ---- supervised layouts -------------------------------------------------------------

_PW = "OVER (PARTITION BY product_code ORDER BY date"


@query("lag_table", with_ctes(
    "SELECT product_code, date, CAST(sales AS BIGINT) AS sales, "
    + ", ".join(f"CAST(lag(sales, {k}) {_PW}) AS BIGINT) AS lag_{k}" for k in range(1, LAGS + 1))
    + " FROM daily", *_FC))
def lag_table(spark, sf_dir):
    return finish(panel.lag_table(product_daily(spark, sf_dir), "product_code", "date", "sales", LAGS))


@query("temporal_split", with_ctes(f"""
SELECT product_code, date, CAST(sales AS BIGINT) AS sales, CAST(round(CAST(price AS DECIMAL(38,10)), 6) AS DOUBLE) AS price,
       CASE WHEN rd <= {HORIZON} THEN 'test' ELSE 'train' END AS split,
       CASE WHEN rd <= {HORIZON} THEN CAST({HORIZON} + 1 - rd AS INTEGER) END AS day
FROM (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY date DESC) AS rd FROM daily)""", *_FC))
def temporal_split(spark, sf_dir):
    return finish(panel.temporal_split(product_daily(spark, sf_dir), "product_code", "date", HORIZON))


@query("cv_folds", with_ctes("""
SELECT product_code, date, CAST(t AS INTEGER) AS t, CAST(fold AS INTEGER) AS fold, role FROM (
  SELECT product_code, date, t, 0 AS fold, 'train' AS role FROM idx WHERE t <= 30 AND n - 31 >= 0
  UNION ALL
  SELECT product_code, date, t, unnest(generate_series(greatest(1, t - 30), least(n - 31, t - 30 + 14))) AS fold, 'train' AS role
  FROM idx WHERE n - 31 >= 0 AND least(n - 31, t - 30 + 14) >= greatest(1, t - 30)
  UNION ALL
  SELECT product_code, date, t, t - 31 AS fold, 'test' AS role FROM idx WHERE t - 31 >= 0 AND t - 31 <= n - 31)""",
    *_FC, ("idx", f"SELECT product_code, date, row_number() {_PW}) AS t, count(*) OVER (PARTITION BY product_code) AS n FROM daily")))
def cv_folds(spark, sf_dir):
    return finish(panel.cv_folds(product_daily(spark, sf_dir), "product_code", "date", 30, 15, 1))


@query("horizon_table", with_ctes(
    "SELECT * FROM (SELECT product_code, origin_date, CAST(h AS INTEGER) AS h, "
    + ", ".join(f"lag_{k}" for k in range(1, LAGS + 1))
    + ", CAST(round(CAST(price AS DECIMAL(38,10)), 6) AS DOUBLE) AS price, target FROM (SELECT product_code, date AS origin_date, "
    + ", ".join(f"CAST(lag(sales, {k - 1}) {_PW}) AS BIGINT) AS lag_{k}" for k in range(1, LAGS + 1))
    + ", " + ", ".join(f"CAST(lead(sales, {h}) {_PW}) AS BIGINT) AS t_{h}, lead(price, {h}) {_PW}) AS p_{h}"
                       for h in range(1, HORIZON + 1))
    + " FROM daily) x, LATERAL (VALUES " + ", ".join(f"({h}, t_{h}, p_{h})" for h in range(1, HORIZON + 1))
    + f") v(h, target, price)) WHERE lag_{LAGS} IS NOT NULL AND target IS NOT NULL", *_FC))
def horizon_table(spark, sf_dir):
    # Prices are rounded a panel row, not in each of the rows made of it.
    return panel.horizon_table(finish(product_daily(spark, sf_dir)), "product_code", "date", "sales",
                               LAGS, HORIZON, exog=["price"])
