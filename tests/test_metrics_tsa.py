import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import metrics, tsa

# Golden values: 14-day actual and forecast series of two products and their
# published mean actual, mean forecast and MAPE (reference result files).
GOLDEN = {
    "507909": ([12, 10, 13, 13, 3, 11, 5, 7, 10, 10, 8, 6, 4, 7],
               [11, 25, 28, 42, 36, 35, 61, 13, 12, 12, 12, 10, 11, 10],
               8.5, 22.714285, 2.4251534180105607),
    "611415": ([43, 26, 30, 31, 63, 51, 50, 40, 52, 48, 47, 53, 40, 24],
               [43, 40, 41, 49, 44, 54, 57, 53, 62, 62, 61, 57, 54, 70],
               42.714285714285715, 53.357143, 0.38822637582838276),
}


def backtest(spark):
    rows = [(k, d + 1, float(a), float(p)) for k, (act, pred, *_) in GOLDEN.items()
            for d, (a, p) in enumerate(zip(act, pred))]
    return spark.createDataFrame(rows, "k string, day int, actual double, forecast double")


def test_golden_means_and_mape(spark):
    bt = backtest(spark)
    means = {r["k"]: r for r in metrics.mean_actual_vs_forecast(bt, "k").collect()}
    mets = {r["k"]: r for r in metrics.forecast_metrics(bt, "k").collect()}
    for k, (_, _, ma, mp, mape) in GOLDEN.items():
        assert means[k]["mean_actual"] == pytest.approx(ma, abs=1e-9)
        assert means[k]["mean_forecast"] == pytest.approx(mp, abs=1e-6)
        assert mets[k]["mape"] == pytest.approx(mape, rel=1e-12)


def test_zero_actuals_are_finite(spark):
    df = spark.createDataFrame([("k", 1, 0.0, 2.0), ("k", 2, 0.0, 0.0), ("k", 3, 4.0, 3.0)],
                               "k string, day int, actual double, forecast double")
    r = metrics.forecast_metrics(df, "k").first()
    assert np.isfinite(r["mape_smoothed"]) and np.isfinite(r["smape"]) and np.isfinite(r["mae"])


def test_rollup_sums_equal_base(spark):
    act = spark.createDataFrame([("s1", d, d * 2) for d in range(1, 15)] + [("s2", d, d) for d in range(1, 15)],
                                "style_group string, day int, units_sold long")
    fc = spark.createDataFrame([("s1", d, 1.0) for d in range(1, 15)] + [("s2", d, 2.0) for d in range(1, 15)],
                               "style_group string, day int, forecast double")
    hier = spark.createDataFrame([("s1", "L", "a"), ("s2", "L", "b")], "style_group string, level3 string, level4 string")
    errs = metrics.style_level_errors(act, fc, hier)
    week = metrics.rollup(metrics.with_week_of_horizon(errs), "level3", "week")
    tot = week.agg(F.sum("actual"), F.sum("forecast")).first()
    assert tot[0] == sum(d * 3 for d in range(1, 15)) and tot[1] == 14 * 3.0


def test_naive_forecast_half_even(spark):
    # Last 14 training values average to 2.5 -> 2 (ties to even).
    vals = [2, 3] * 7 + [9] * 14
    df = spark.createDataFrame([("k", dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)],
                               "k string, d date, y long")
    out = metrics.naive_forecast(df, "k", "d", "y").collect()
    assert len(out) == 14 and {r["forecast"] for r in out} == {2.0}


def _classical(y, p):
    n = len(y)
    if p % 2:
        w = np.ones(p) / p
    else:
        w = np.r_[0.5, np.ones(p - 1), 0.5] / p
    h = len(w) // 2
    trend = np.full(n, np.nan)
    for i in range(h, n - h):
        trend[i] = np.dot(w, y[i - h:i + h + 1])
    det = y - trend
    pm = np.array([np.nanmean(det[i::p]) for i in range(p)])
    pm -= pm.mean()
    seas = np.tile(pm, n // p + 1)[:n]
    return trend, seas


@pytest.mark.parametrize("period", [7, 12])
def test_decomposition_matches_classical(spark, period):
    rng = np.random.default_rng(0)
    n = 60
    y = 10 + 0.3 * np.arange(n) + 3 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(0, 1, n)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "k string, t int, y double")
    out = tsa.seasonal_decompose(df, "k", "t", "y", period).orderBy("t").toPandas()
    trend, seas = _classical(y, period)
    np.testing.assert_allclose(out["trend"].to_numpy(dtype=float), trend, atol=1e-9)
    np.testing.assert_allclose(out["seasonal"].to_numpy(dtype=float), seas, atol=1e-9)
    ok = ~np.isnan(trend)
    np.testing.assert_allclose((out["trend"] + out["seasonal"] + out["resid"]).to_numpy(dtype=float)[ok], y[ok], atol=1e-9)


def test_periodogram_matches_direct_dft(spark):
    rng = np.random.default_rng(1)
    y = rng.poisson(5, 41).astype(float)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "key string, t int, y double")
    got = tsa.periodogram(df, "key", "t", "y").toPandas().sort_values("k")
    n = len(y)
    t = np.arange(n)
    b, a = np.polyfit(t, y, 1)
    r = y - (a + b * t)
    want = []
    for k in range(n // 2 + 1):
        s = np.sum(r * np.exp(-2j * np.pi * k * t / n))
        m = 1.0 if k == 0 or 2 * k == n else 2.0
        want.append(m * abs(s) ** 2 / n ** 2)
    np.testing.assert_allclose(got["power"].to_numpy(), want, atol=1e-10)
    assert got["frequency"].iloc[1] == pytest.approx(365.0 / n)


def test_adf_separates_walk_from_stationary(spark):
    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.normal(0, 1, 300))
    ar = np.zeros(300)
    for i in range(1, 300):
        ar[i] = 0.2 * ar[i - 1] + rng.normal()
    rows = [("walk", i, float(v)) for i, v in enumerate(walk)] + [("ar", i, float(v)) for i, v in enumerate(ar)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    res = {r["k"]: r for r in tsa.adf_test(df, "k", "t", "y", max_lag=4).collect()}
    assert res["ar"]["adf_stat"] < res["ar"]["crit_1pct"]
    assert res["walk"]["adf_stat"] > res["walk"]["crit_5pct"]
    assert res["ar"]["crit_1pct"] < res["ar"]["crit_5pct"] < res["ar"]["crit_10pct"]
    assert res["ar"]["p_value"] < 0.01 < 0.05 < res["walk"]["p_value"] <= 1


def test_adf_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    series = {"a": rng.normal(0, 1, 90).cumsum(), "b": rng.normal(0, 1, 60), "short": np.arange(3.0)}
    rows = [(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    res = {r["k"]: r for r in tsa.adf_test(df, "k", "t", "y", max_lag=2, autolag=False).collect()}
    for k in "ab":
        y = series[k]
        dy = np.diff(y)
        x = np.stack([np.ones(len(y) - 3), y[2:-1], dy[1:-1], dy[:-2]], 1)
        beta, ssr, *_ = np.linalg.lstsq(x, dy[2:], rcond=None)
        se = np.sqrt(ssr[0] / (len(x) - 4) * np.linalg.inv(x.T @ x)[1, 1])
        assert res[k]["adf_stat"] == pytest.approx(beta[1] / se, rel=1e-8) and res[k]["n_obs"] == len(x)
    assert res["short"]["adf_stat"] is None and res["short"]["n_obs"] == 0


def test_adf_search_query_by_definition(spark, sf_small):
    """The registered query searches the lag of every series of the given table."""
    from tillroll.plans.catalog import queries
    from tillroll.plans.tsa_queries import weekly_name_sales

    def fit(y, lags, first):
        dy = np.diff(y)
        t = np.arange(first, len(dy))
        x = np.stack([np.ones(len(t)), y[t], *[dy[t - j] for j in range(1, lags + 1)]], 1)
        beta = np.linalg.lstsq(x, dy[t], rcond=None)[0]
        ssr = ((dy[t] - x @ beta) ** 2).sum()
        return beta[1] / np.sqrt(ssr / (len(t) - 2 - lags) * np.linalg.inv(x.T @ x)[1, 1]), ssr, len(t)

    res = {r["prod_name"]: r for r in queries()["adf_search"](spark, sf_small).collect()}
    weekly = weekly_name_sales(spark, sf_small).toPandas().sort_values("week_end")
    series = {k: g["sales"].to_numpy(float) for k, g in weekly.groupby("prod_name")}
    assert res.keys() == series.keys() and len({r["used_lag"] for r in res.values()}) > 1
    for k in sorted(series)[:40]:
        y, r = series[k], res[k]
        cap = tsa.default_max_lag(len(y))
        aic = []
        for p in range(cap + 1):
            _, ssr, n = fit(y, p, cap)
            aic.append(n * np.log(ssr / n) + 2 * (2 + p))
        assert r["used_lag"] == int(np.argmin(aic))
        stat, _, n = fit(y, r["used_lag"], r["used_lag"])
        assert r["n_obs"] == n and r["adf_stat"] == pytest.approx(stat, abs=2e-6)
        assert r["p_value"] == pytest.approx(tsa.adf_p_value(stat), abs=2e-6)
        for level, *c in tsa.ADF_CRITICAL_CONSTANT:
            assert r[f"crit_{level[:-1]}pct"] == pytest.approx(sum(v / n ** i for i, v in enumerate(c)), abs=2e-6)


def test_adf_undefined_series(spark):
    """Constant, perfectly fitted, gapped and empty series are rows of nulls, beside a usable one."""
    rng = np.random.default_rng(8)
    series = {"flat": [3.0] * 40, "line": [float(i) for i in range(40)], "gap": [1.0, None, 2.0] * 12, "nan": [float("nan")] * 30,
              "two": [1.0, 2.0], "good": [float(v) for v in rng.normal(0, 1, 40)]}
    df = spark.createDataFrame([(k, i, v) for k, y in series.items() for i, v in enumerate(y)], "k string, t int, y double")
    res = {r["k"]: r for r in tsa.adf_test(df, "k", "t", "y").collect()}
    assert res.keys() == series.keys() and res["good"]["adf_stat"] < -2 and res["good"]["p_value"] < 0.5
    for k in ("flat", "line"):  # regressions exist, their columns depend on each other or leave no residual
        assert res[k]["adf_stat"] is None and res[k]["p_value"] is None and res[k]["n_obs"] == 39 - res[k]["used_lag"]
    for k in ("gap", "nan", "two"):
        assert res[k]["n_obs"] == 0 and res[k]["used_lag"] is None and res[k]["crit_5pct"] is None
    assert tsa.adf_test(df.limit(0), "k", "t", "y").count() == 0


def test_elimination_holds_every_nested_regression():
    from tillroll.functions.linear import eliminate_in_order
    rng = np.random.default_rng(4)
    rows = rng.normal(0, 1, (3, 50, 6)) + 100.0
    rows[:, :, 3] = rows[:, :, 1] + rows[:, :, 2]  # dependent: takes nothing out
    live, norm, dot, rest = eliminate_in_order(rows)
    assert live.tolist() == [[True, True, True, False, True]] * 3
    for i in range(3):
        for k in range(1, 6):
            x, y = rows[i, :, :k], rows[i, :, 5]
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            assert rest[i, k - 1] == pytest.approx(((y - x @ beta) ** 2).sum(), rel=1e-9)
        assert dot[i, 4] / norm[i, 4] == pytest.approx(np.linalg.lstsq(rows[i][:, [0, 1, 2, 4]], rows[i, :, 5], rcond=None)[0][-1], rel=1e-9)


def test_adf_p_values_at_known_points():
    # The 5 % and 10 % points of the statistic in large samples.
    assert tsa.adf_p_value(-2.86154) == pytest.approx(0.05, abs=2e-3)
    assert tsa.adf_p_value(-2.56677) == pytest.approx(0.10, abs=3e-3)
    assert tsa.adf_p_value(-20.0) == 0.0 and tsa.adf_p_value(3.0) == 1.0


def test_linear_detrend_residuals(spark):
    df = spark.createDataFrame([("k", i, 2.0 + 0.5 * i + (1 if i % 2 else -1)) for i in range(50)],
                               "k string, t int, y double")
    out = tsa.linear_detrend(df, "k", "t", "y")
    agg = out.agg(F.sum("detrended"), F.first("slope")).first()
    assert abs(agg[0]) < 1e-9 and agg[1] == pytest.approx(0.5, abs=0.01)


def test_wide_table_layout_golden(spark):
    bt = backtest(spark)
    wide = metrics.wide_actual_prediction(bt, "k").orderBy("day").toPandas()
    assert list(wide["day"]) == list(range(1, 15))
    assert {"actual_507909", "prediction_507909", "actual_611415", "prediction_611415"} <= set(wide.columns)
    for k, (act, pred, *_) in GOLDEN.items():
        assert list(wide[f"actual_{k}"]) == [float(a) for a in act]
        assert list(wide[f"prediction_{k}"]) == [float(p) for p in pred]
