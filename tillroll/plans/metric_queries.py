"""Registered queries: baseline forecasts, metrics, roll-ups, wide tables,
lookup and scoring sets (T10-T12, T15, T17, A24-A27, F14-F16, S8, S10,
S11, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import features, metrics, panel
from tillroll.operators.prep import small_table
from tillroll.plans.panel_queries import (HORIZON, _FC, _STYLE, _long_lived_rows,
                                          _product_features_sql, product_daily, style_panel)
from tillroll.plans.registry import finish, query
from tillroll.plans.sqlparts import with_ctes


def _naive_sql(src: str, key: str, date: str, value: str, name: str = "nf") -> list[tuple[str, str]]:
    return [
        (f"{name}_split", f"SELECT {key}, {date}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY {date} DESC) AS rd FROM {src}"),
        (f"{name}_recent", f"SELECT {key}, avg({value}) AS m FROM {name}_split WHERE rd > {HORIZON} AND rd <= {2 * HORIZON} GROUP BY {key}"),
        (name, f"""SELECT s.{key}, CAST({HORIZON} + 1 - s.rd AS INTEGER) AS day, s.{date}, CAST(s.{value} AS DOUBLE) AS actual,
                          CAST(CASE WHEN round_even(r.m, 0) < 0 THEN 0 ELSE round_even(r.m, 0) END AS DOUBLE) AS forecast
                   FROM {name}_split s LEFT JOIN {name}_recent r ON s.{key} = r.{key} WHERE s.rd <= {HORIZON}"""),
    ]


_NF = _FC + _naive_sql("daily", "product_code", "date", "sales")
_NFS = _STYLE + _naive_sql("sp", "style_group", "transaction_date", "units_sold", "nfs") + [
    ("hier", "SELECT DISTINCT style_group, level3, level4 FROM sp"),
    ("err", """SELECT a.style_group, a.day, CAST(a.actual AS BIGINT) AS units_sold, f.forecast, h.level3, h.level4,
                      abs(a.actual - f.forecast) AS abs_error, abs(a.actual - f.forecast) / (a.actual + 0.2) AS abs_percentage_error
               FROM (SELECT style_group, day, actual FROM nfs) a
               LEFT JOIN (SELECT style_group, day, forecast FROM nfs) f ON a.style_group = f.style_group AND a.day = f.day
               LEFT JOIN hier h ON a.style_group = h.style_group""")]


def product_backtest(spark, sf_dir):
    return metrics.naive_forecast(product_daily(spark, sf_dir), "product_code", "date", "sales", HORIZON, HORIZON)


def style_backtest(spark, sf_dir):
    return metrics.naive_forecast(style_panel(spark, sf_dir), "style_group", "transaction_date",
                                  "units_sold", HORIZON, HORIZON)


def style_errors(spark, sf_dir):
    # The backtest (actuals and forecasts) and the hierarchy read one panel.
    sp = small_table(style_panel(spark, sf_dir))
    bt = metrics.naive_forecast(sp, "style_group", "transaction_date", "units_sold", HORIZON, HORIZON)
    actuals = bt.select("style_group", "day", F.col("actual").cast("bigint").alias("units_sold"))
    forecasts = bt.select("style_group", "day", "forecast")
    hier = sp.select("style_group", "level3", "level4").distinct()
    return metrics.style_level_errors(actuals, forecasts, hier)


@query("naive_forecast_rounded", with_ctes(
    "SELECT product_code, day, date, actual, forecast FROM nf", *_NF))
def naive_forecast_rounded(spark, sf_dir):
    return finish(product_backtest(spark, sf_dir))


@query("forecast_metrics", with_ctes("""
SELECT product_code,
       CAST(round(CAST(avg(abs(actual - forecast) / greatest(abs(actual), 2.220446049250313e-16)) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mape,
       CAST(round(CAST(avg(abs(actual - forecast) / (actual + 0.1)) * 100 AS DECIMAL(38,10)), 6) AS DOUBLE) AS mape_smoothed,
       CAST(round(CAST(avg(abs(actual - forecast)) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mae,
       CAST(round(CAST(round(avg(abs(forecast - actual) / ((abs(forecast) + abs(actual) + 0.1) / 2)) * 100, 2) AS DECIMAL(38,10)), 6) AS DOUBLE) AS smape
FROM nf GROUP BY product_code""", *_NF))
def forecast_metrics(spark, sf_dir):
    return finish(metrics.forecast_metrics(product_backtest(spark, sf_dir), "product_code"))


@query("mean_actual_vs_forecast", with_ctes("""
SELECT product_code, CAST(round(CAST(avg(actual) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_actual, CAST(round(CAST(avg(forecast) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_forecast
FROM nf GROUP BY product_code""", *_NF))
def mean_actual_vs_forecast(spark, sf_dir):
    return finish(metrics.mean_actual_vs_forecast(product_backtest(spark, sf_dir), "product_code"))


@query("wide_actual_prediction", with_ctes("""
SELECT * FROM (SELECT day, 'actual_' || CAST(product_code AS VARCHAR) AS name, actual AS v FROM nf
               UNION ALL SELECT day, 'prediction_' || CAST(product_code AS VARCHAR) AS name, forecast AS v FROM nf)
WHERE v IS NOT NULL""", *_NF))
def wide_actual_prediction(spark, sf_dir):
    """The wide table, in blocks of columns (their number grows with the
    products), reported by its cells."""
    backtest = small_table(product_backtest(spark, sf_dir))
    wide = metrics.wide_actual_prediction(backtest, "product_code", block_keys=metrics.BLOCK_KEYS)
    return finish(metrics.long_form(wide, "day"))


@query("style_errors", with_ctes("""
SELECT style_group, day, units_sold, forecast, level3, level4, CAST(round(CAST(abs_error AS DECIMAL(38,10)), 6) AS DOUBLE) AS abs_error,
       CAST(round(CAST(abs_percentage_error AS DECIMAL(38,10)), 6) AS DOUBLE) AS abs_percentage_error FROM err""", *_NFS))
def style_errors_q(spark, sf_dir):
    return finish(style_errors(spark, sf_dir))


@query("overall_mape", with_ctes("SELECT CAST(round(CAST(avg(abs_percentage_error) * 100 AS DECIMAL(38,10)), 6) AS DOUBLE) AS overall_mape FROM err", *_NFS))
def overall_mape(spark, sf_dir):
    return finish(metrics.overall_mape(style_errors(spark, sf_dir)))


def _rollup_sql(period_expr: str, period: str) -> str:
    return with_ctes(f"""
SELECT level3, {period}, actual, forecast, CAST(round(CAST(abs(actual - forecast) AS DECIMAL(38,10)), 6) AS DOUBLE) AS abs_error,
       CAST(round(CAST(abs(actual - forecast) / NULLIF(actual, 0) AS DECIMAL(38,10)), 6) AS DOUBLE) AS abs_percentage_error
FROM (SELECT level3, {period_expr} AS {period}, CAST(sum(units_sold) AS DOUBLE) AS actual,
             CAST(sum(forecast) AS DOUBLE) AS forecast FROM err GROUP BY ALL)""", *_NFS)


@query("forecast_rollup_day", _rollup_sql("day", "day"))
def forecast_rollup_day(spark, sf_dir):
    return finish(metrics.rollup(style_errors(spark, sf_dir), "level3", "day"))


@query("forecast_rollup_week", _rollup_sql("CASE WHEN day <= 7 THEN 1 ELSE 2 END", "week"))
def forecast_rollup_week(spark, sf_dir):
    errs = metrics.with_week_of_horizon(style_errors(spark, sf_dir))
    return finish(metrics.rollup(errs, "level3", "week"))


_LOOKUP = ("lookup", "SELECT product_code, min(prod_name) AS prod_name FROM fc_rows WHERE product_code IS NOT NULL GROUP BY product_code")


@query("code_name_lookup", with_ctes("SELECT product_code, prod_name FROM lookup", *_FC, _LOOKUP))
def code_name_lookup(spark, sf_dir):
    rows = _long_lived_rows(spark, sf_dir)
    return finish(rows.where(F.col("product_code").isNotNull())
                  .groupBy("product_code").agg(F.min("prod_name").alias("prod_name")))


@query("forecast_union", with_ctes("""
SELECT l.prod_name AS prod, n.forecast, n.day FROM nf n JOIN lookup l ON n.product_code = l.product_code
UNION ALL
SELECT style_group AS prod, forecast, day FROM nfs""",
                                   *_NF, _LOOKUP, *_STYLE,
                                   *_naive_sql("sp", "style_group", "transaction_date", "units_sold", "nfs")))
def forecast_union(spark, sf_dir):
    # One pass over the rows gives the daily panel and the names.
    rows = _long_lived_rows(spark, sf_dir)
    daily = small_table(rows.where(F.col("product_code").isNotNull()).groupBy("product_code", F.col("t_dat").alias("date"))
                        .agg(F.count(F.lit(1)).alias("sales"), F.min("prod_name").alias("prod")))
    lookup = daily.groupBy("product_code").agg(F.min("prod").alias("prod"))
    backtest = metrics.naive_forecast(daily, "product_code", "date", "sales", HORIZON, HORIZON)
    prod = backtest.join(lookup, "product_code").select("prod", "forecast", "day")
    style = style_backtest(spark, sf_dir).select(F.col("style_group").alias("prod"), "forecast", "day")
    return finish(prod.unionByName(style))


_TEST_ROWS = ("test_rows", f"""SELECT *, CAST({HORIZON} + 1 - rd AS INTEGER) AS forecast_day FROM
    (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY date DESC) AS rd FROM daily) WHERE rd <= {HORIZON}""")


@query("scoring_set", _product_features_sql("test_rows", ", forecast_day", _FC + [_TEST_ROWS]))
def scoring_set(spark, sf_dir):
    """Feature rows of the last 14 days per product with their
    horizon day (the inference input), plus the target."""
    daily = product_daily(spark, sf_dir)
    split = panel.temporal_split(daily, "product_code", "date", HORIZON)
    test = split.where(F.col("split") == "test").withColumnRenamed("day", "forecast_day")
    return finish(features.product_features(test).join(
        test.select("product_code", "date", "forecast_day"), ["product_code", "date"]))
