"""End-to-end jobs: the reference's three scripts as Spark jobs.

* :func:`co_purchase_report_job` - prepare rows, build the all-item report
  at any grain, write it and the item support table (report script).
* :func:`train_forecast_job` - prepare and filter products, fit the pooled
  forecaster, save the model, write the backtest (wide and per-product
  metrics) and the scoring set (training script).
* :func:`score_job` - load the saved model and the scoring set, write the
  forecasts per product and combined (inference script).

Inputs are DataFrames (read them with :mod:`tillroll.sources.io`); outputs
go to folders the caller names, normally under shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import basket, forecast, metrics, prep
from tillroll.session import materialise
from tillroll.sources.io import read_csv_table, read_table, write_csv_table, write_partitioned, write_table


def co_purchase_report_job(transactions: DataFrame, articles: DataFrame, out: str,
                           hierarchy: str = "prod_name", n: int = 3, penetration: float = 0.0,
                           min_cnt: int = 0, prods=None, fmt: str = "csv") -> DataFrame:
    """R1 + R3/R5 + S5: writes ``{out}/report`` and ``{out}/support``;
    returns the report as read back."""
    rows = prep.prepare_basket_rows(transactions, articles, penetration, min_cnt)
    sized = basket.materialized_cells(rows, hierarchy)
    report = basket.co_purchase_report(rows, hierarchy, n, prods=prods, sized=sized)
    support = basket.item_support(rows, hierarchy, sized=sized)
    write_table(support, f"{out}/support")
    if fmt == "csv":
        write_csv_table(report, f"{out}/report")
        return read_csv_table(rows.sparkSession, f"{out}/report", report.schema)
    write_table(report, f"{out}/report", fmt=fmt)
    return read_table(rows.sparkSession, f"{out}/report", fmt)


def train_forecast_job(transactions: DataFrame, articles: DataFrame, out: str,
                       penetration: float = 0.01, first_by=None, last_from=None,
                       lags: int = 30, horizon: int = 14, transforms=()) -> dict:
    """R2 + P8 + A11 + T6 + T7 + T9 + T10 + S8-S11 in one job.

    Writes ``{out}/model`` (one pipeline for all products),
    ``{out}/backtest_wide`` (CSV), ``{out}/metrics``, ``{out}/lookup`` and
    ``{out}/scoring_set``; returns their paths.
    """
    rows = prep.prepare_forecast_rows(transactions, articles, 0.0, penetration,
                                      first_by=first_by, last_from=last_from)
    daily = (rows.groupBy("product_code", F.col("t_dat").alias("date"))
                 .agg(F.count(F.lit(1)).alias("sales"), F.avg("price").alias("price")))
    frame = forecast.supervised_frame(daily, "product_code", "date", "sales", lags, horizon, horizon,
                                      transforms=transforms, spread="origins")
    frame = materialise(forecast.with_product_features(frame), "frame")
    scored, model = forecast.rf_forecast(frame, "product_code", lags, forecast.PRODUCT_MODEL_FEATURES)
    # The backtest is read by the wide table and by both metric tables.
    backtest = materialise(scored, "backtest")
    paths = {k: f"{out}/{k}" for k in ("model", "backtest_wide", "metrics", "lookup", "scoring_set")}
    forecast.save_model(model, paths["model"])
    write_table(metrics.wide_actual_prediction(backtest, "product_code"), paths["backtest_wide"], fmt="csv")
    write_table(metrics.forecast_metrics(backtest, "product_code")
                .join(metrics.mean_actual_vs_forecast(backtest, "product_code"), "product_code"), paths["metrics"])
    write_table(rows.groupBy("product_code").agg(F.min("prod_name").alias("prod")), paths["lookup"])
    write_table(frame.where(F.col("role") == "score"), paths["scoring_set"])
    return paths


def score_job(model_path: str, scoring_path: str, lookup_path: str, out: str, spark) -> DataFrame:
    """S4 + S9 + T14 + S7: forecasts of every product from the saved model,
    written as one folder per product code and one combined table
    ``(prod, forecast, day)``; returns the combined table as read back."""
    model = forecast.load_model(model_path)
    scoring = read_table(spark, scoring_path)
    lookup = read_table(spark, lookup_path)
    fc = (forecast.to_forecast(model.transform(scoring), "product_code")
          .join(lookup, "product_code").select("product_code", "prod", "forecast", "day"))
    write_table(fc.select("prod", "forecast", "day"), f"{out}/all_product_prediction", fmt="csv")
    # One folder per product code (names are not unique per code).
    write_partitioned(fc, f"{out}/by_product", "product_code")
    return read_table(spark, f"{out}/all_product_prediction", "csv",
                      schema="prod string, forecast double, day int")
