import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import elasticity, forecast, metrics


def test_nearly_dependent_regressors(spark):
    """Columns that differ by one part in ten thousand: moments would lose
    eight digits; groups lie in many batches, one holds most rows."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g, n in (("a", 4000), ("b", 30), ("c", 5), ("d", 4), (None, 40)):
        base = rng.uniform(5, 10, (n, 1))
        x = base + np.concatenate([np.zeros((n, 1)), 1e-3 * rng.standard_normal((n, 2)), rng.standard_normal((n, 1))], 1)
        y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + 1e-3 * rng.standard_normal(n)
        rows += [(g, *map(float, r), float(v)) for r, v in zip(x, y)]
        q, r = np.linalg.qr(x)
        beta = np.linalg.solve(r, q.T @ y)
        ssr = ((y - x @ beta) ** 2).sum()
        inverse = np.linalg.inv(r)
        se = np.sqrt(ssr / (n - 4) * (inverse ** 2).sum(axis=1)) if n > 4 else None
        want[g] = (beta, se)
    rng.shuffle(rows)
    design = spark.createDataFrame([tuple(r) for r in rows], "style_label string, p_1 double, p_2 double, p_3 double, p_4 double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = {(r.style_label, r.regressor): r for r in elasticity.no_intercept_ols(design.repartition(7), 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 20
    for g, (beta, se) in want.items():
        for k in range(4):
            r = got[g, f"p_{k + 1}"]
            assert r.coef == pytest.approx(beta[k], rel=1e-9, abs=1e-9)
            assert r.std_err is None if se is None else r.std_err == pytest.approx(se[k], rel=1e-7)


def test_no_intercept_ols_matches_lstsq(spark):
    rng = np.random.default_rng(3)
    n, k = 80, 3
    X = rng.uniform(5, 10, (n, k))
    beta = np.array([1.5, -2.0, 0.7])
    y = X @ beta + rng.normal(0, 0.1, n)
    rows = [("s", i, float(y[i]), *map(float, X[i])) for i in range(n)]
    design = spark.createDataFrame(rows, "style_label string, d int, y double, p_1 double, p_2 double, p_3 double")
    got = elasticity.no_intercept_ols(design, k).orderBy("regressor").toPandas()
    want, res, *_ = np.linalg.lstsq(X, y, rcond=None)
    np.testing.assert_allclose(got["coef"].to_numpy(), want, rtol=1e-8)
    sigma2 = res[0] / (n - k)
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(X.T @ X)))
    np.testing.assert_allclose(got["std_err"].to_numpy(), se, rtol=1e-6)
    np.testing.assert_allclose(got["t_value"].to_numpy(), want / se, rtol=1e-6)
    assert (got["p_value"] < 1e-6).all()


def test_p_values_against_known_values():
    from tillroll.functions.linear import fit_triangles, normal_cdf, t_test_p
    # Tables of Student's t: two-sided 5 % points.
    got = t_test_p(np.array([12.706205, 2.228139, 1.983972]), np.array([1, 10, 100]))
    np.testing.assert_allclose(got, 0.05, atol=1e-6)
    # One degree of freedom has a closed form; an unknown statistic has no p.
    np.testing.assert_allclose(t_test_p(np.array([0.3]), np.array([1])), 1 - 2 * np.arctan(0.3) / np.pi, rtol=1e-9)
    assert np.isnan(t_test_p(np.array([np.nan, 1.0]), np.array([3, 0]))).all()
    assert abs(normal_cdf(1.959963985) - 0.975) < 1e-9
    rows = np.array([[1.0, 2.0, 1.0], [2.0, 4.0, 3.0], [3.0, 6.0, 2.0]])  # dependent columns
    assert not fit_triangles(np.linalg.qr(rows, mode="r")[None])[4][0]


def test_regression_design_complete_cases(spark):
    d = [dt.date(2020, 1, i) for i in range(1, 4)]
    prices = spark.createDataFrame([(d[0], 1, 1.0), (d[0], 2, 2.0), (d[1], 1, 1.5)],
                                   "transaction_date date, rank int, price double")
    target = spark.createDataFrame([("s", d[0], 3), ("s", d[1], 4), ("s", d[2], 5)],
                                   "style_label string, transaction_date date, units_sold int")
    out = elasticity.regression_design(target, prices, 2).collect()
    assert len(out) == 1 and out[0]["transaction_date"] == d[0]


def test_safe_corr_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "k string, x double, y double")
    assert df.groupBy("k").agg(elasticity.safe_corr("x", "y").alias("c")).first()["c"] is None


def _periodic_panel(spark, keys=4, days=220):
    rows = []
    start = dt.date(2020, 1, 1)
    for k in range(keys):
        for i in range(days):
            y = 10 + 5 * k + (8 if i % 7 in (5, 6) else 0)
            rows.append((k, start + dt.timedelta(days=i), y, 10.0))
    return spark.createDataFrame(rows, "product_code int, date date, sales long, price double")


def test_rf_forecast_shape_and_baseline(spark):
    daily = _periodic_panel(spark)
    frame = forecast.supervised_frame(daily, "product_code", "date", "sales", 14, 14, 14)
    out, model = forecast.rf_forecast(frame, "product_code", 14)
    pdf = out.toPandas()
    assert len(pdf) == 4 * 14 and (pdf.groupby("product_code").size() == 14).all()
    assert (pdf["forecast"] >= 0).all() and (pdf["forecast"] == pdf["forecast"].round()).all()
    naive = metrics.naive_forecast(daily, "product_code", "date", "sales").toPandas()
    rf_mae = (pdf["actual"] - pdf["forecast"]).abs().mean()
    naive_mae = (naive["actual"] - naive["forecast"]).abs().mean()
    assert rf_mae <= naive_mae
    imp = forecast.feature_importance(spark, model).toPandas()
    assert abs(imp["importance"].sum() - 1.0) < 1e-9
    assert imp["cum_importance"].is_monotonic_increasing


def test_gbt_candidates_are_seeded_grid_draws():
    a, b = forecast.gbt_candidates(5, 42), forecast.gbt_candidates(5, 42)
    assert a == b and len({tuple(sorted(c.items())) for c in a}) == 5
    for c in a:
        for k, v in c.items():
            assert v in forecast.GBT_GRID[k]


def test_model_save_load(spark, tmp_path):
    from tillroll.session import scratch_path
    daily = _periodic_panel(spark, keys=2, days=120)
    frame = forecast.supervised_frame(daily, "product_code", "date", "sales", 7, 14, 14)
    model = forecast.fit_rf(frame, 7)
    path = scratch_path(spark, "test-model")
    forecast.save_model(model, path)
    again = forecast.load_model(path)
    score = frame.where(F.col("role") == "score")
    a = sorted(r["prediction"] for r in model.transform(score).collect())
    b = sorted(r["prediction"] for r in again.transform(score).collect())
    assert a == b


def test_target_adjustment_inverts(spark):
    from tillroll.operators import forecast as fc
    daily = _periodic_panel(spark, keys=2, days=200)
    adj = fc.target_adjustment(daily, "product_code", "date", "sales", 14, ("deseasonalise", "detrend"), 7)
    pdf = adj.toPandas()
    assert np.allclose(pdf["_y"] + pdf["_shift"], pdf["sales"])
    # A weekly pattern is removed: the adjusted series is nearly flat.
    assert pdf.groupby("product_code")["_y"].std().max() < 1.0
    frame = fc.supervised_frame(daily, "product_code", "date", "sales", 14, 14, 14,
                                transforms=("deseasonalise", "detrend"), period=7)
    out, _ = fc.rf_forecast(frame, "product_code", 14)
    p = out.toPandas()
    assert len(p) == 28 and (p["forecast"] >= 0).all()
    assert (p["actual"] - p["forecast"]).abs().mean() < 2.0


def test_gbt_search_beats_naive_on_periodic_series(spark):
    daily = _periodic_panel(spark, keys=3, days=160)
    frame = forecast.supervised_frame(daily, "product_code", "date", "sales", 14, 14, 14).checkpoint(eager=True)
    out, best, results = forecast.gbt_forecast(frame, "product_code", 14, n_draws=2, max_iter=20)
    pdf = out.toPandas()
    assert len(pdf) == 3 * 14 and len(results) == 2 and best in [r[0] for r in results]
    naive = metrics.naive_forecast(daily, "product_code", "date", "sales").toPandas()
    assert (pdf["actual"] - pdf["forecast"]).abs().mean() <= (naive["actual"] - naive["forecast"]).abs().mean()


def test_gbt_search_equals_plain_fits(spark):
    """The held rows of a fold group give the fits on the assembled frame; no table of vectors is written and nothing stays cached."""
    from pathlib import Path
    from tillroll.session import checkpoint_dir
    daily = _periodic_panel(spark, keys=2, days=120)
    frame = forecast.supervised_frame(daily, "product_code", "date", "sales", 20, 14, 14).coalesce(1).checkpoint(eager=True)
    found = lambda: {p.name for p in Path(checkpoint_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith("aggregate-")}
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    written, held = found(), cached()
    model, best, results = forecast.gbt_search(frame, 20, n_draws=2, max_iter=3)
    assert found() == written and cached() == held
    groups, role = forecast.fold_groups(horizon=14)
    for setting, error in results:
        sums = rows = 0
        for g in range(groups):
            stage = forecast._assembler(forecast.feature_columns(min(setting["window"], 20)))
            own = stage.transform(frame.where(role(g).isNotNull()).withColumn("_valid", role(g) == "valid"))
            fitted = forecast._boosted(setting, 3, 42, validationIndicatorCol="_valid").fit(own)
            scored = fitted.transform(own.where("_valid")).select("prediction", "target").toPandas()
            sums, rows = sums + (scored.prediction - scored.target).abs().sum(), rows + len(scored)
        assert error == pytest.approx(sums / rows, rel=1e-12)
    assert best == min(results, key=lambda r: r[1])[0] and model.stages[0].getInputCols()


def test_fold_groups_by_definition(spark):
    """Windows of 15 rows and horizons of 14, every 14 rows from row 30 on, over the whole history."""
    daily = _periodic_panel(spark, keys=1, days=150)
    frame = forecast.supervised_frame(daily, "product_code", "date", "sales", 5, 14, 14)
    groups, role = forecast.fold_groups(30, 15, 14)
    assert groups == 3
    rows = frame.select("h", "behind", "ahead", *[role(g).alias(f"g{g}") for g in range(groups)], (F.col("position") + 1).alias("p")).collect()
    train_rows, ends = 136, [30 + 14 * f for f in range(20) if 30 + 14 * f + 14 <= 136]
    assert len(rows) > 1000 and len(ends) == 7
    for r in rows:
        for g in range(groups):
            own = ends[g::groups]
            want = None
            if r.ahead >= 0 and r.p - r.h in own:
                want = "valid"
            elif r.ahead >= 0 and any(e - 15 < r.p <= e for e in own):
                want = "train"
            assert r[f"g{g}"] == want and train_rows - r.p == r.ahead
    for g in range(groups):
        trained = {r.p for r in rows if r[f"g{g}"] == "train"}
        assert not trained & {r.p for r in rows if r[f"g{g}"] == "valid"}  # no target on both sides


def test_fit_store(spark, tmp_path):
    daily = _periodic_panel(spark, keys=2, days=100)
    folder = str(tmp_path / "daily")
    daily.write.parquet(folder)
    source, store, made = spark.read.parquet(folder), forecast.FitStore(spark, str(tmp_path / "fits")), []

    def model(digest, **settings):
        def make():
            made.append(settings)
            return forecast.fit_rf(frame, 7, num_trees=settings["trees"])
        return store.model(digest, settings, make)

    digest = forecast.source_digest(source)
    frame = store.frame(digest, {"lags": 7}, lambda: forecast.supervised_frame(source, "product_code", "date", "sales", 7, 14, 14))
    first, again = model(digest, trees=3), model(forecast.source_digest(spark.read.parquet(folder)), trees=3)
    score = frame.where("role = 'score'")
    assert made == [{"trees": 3}]  # fitted once
    same = lambda m: sorted(r.prediction for r in m.transform(score).collect())
    assert same(first) == same(again)
    assert model(digest, trees=4).stages[-1].getNumTrees == 4 and len(made) == 2  # a setting
    daily.limit(50).write.mode("append").parquet(folder)
    model(forecast.source_digest(spark.read.parquet(folder)), trees=3)
    assert len(made) == 3  # the data


def test_paired_skill(spark):
    rows = [("a", 5.0, 4.0, 7.0), ("a", 2.0, 2.0, 5.0), ("a", 3.0, 5.0, 4.0), ("b", 1.0, 1.0, 1.0), ("b", None, 2.0, 2.0), (None, 4.0, 6.0, 5.0)]
    got = {r.k: r for r in metrics.paired_skill(spark.createDataFrame(rows, "k string, actual double, forecast double, naive double"), "k").collect()}
    d = np.array([1 - 2, 0 - 3, 2 - 1.0])
    assert (got["a"].n, got["a"].as_good, got[None].as_good) == (3, 1, 0)
    assert got["a"].t_value == pytest.approx(d.mean() / (d.std(ddof=1) / 3 ** 0.5)) and got["b"].t_value is None
    assert (got["b"].n, got["b"].mae_model) == (1, 0.0)


def test_permutation_importance_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = rng.normal(0, 1, (n, 4))
    y = 5 * x[:, 0] + 2 * x[:, 1] + 0.01 * rng.normal(0, 1, n)
    rows = [(i // 7, i % 7, *map(float, x[i]), float(y[i])) for i in range(n)]
    names = [f"x{k}" for k in range(4)]
    frame = spark.createDataFrame(rows, "k int, d int, x0 double, x1 double, x2 double, x3 double, target double").repartition(3)
    model = forecast.rf_pipeline(names, num_trees=8).fit(frame)
    got = {r.feature: r for r in forecast.permutation_importance(model, frame, ["k", "d"]).collect()}
    hashed = frame.selectExpr("*", "concat_ws('|', cast(k as string), cast(d as string)) AS id") \
        .selectExpr("*", "xxhash64(id, 42) AS a", "xxhash64(id, 43) AS b").collect()
    own = sorted(hashed, key=lambda r: (-r.a, r.id))
    donors = sorted(hashed, key=lambda r: (-r.b, r.id))
    def mae(feature):
        swapped = [tuple(float(z[c] if c == feature else r[c]) for c in names) + (r.target,) for r, z in zip(own, donors)]
        df = spark.createDataFrame(swapped, ", ".join(f"{c} double" for c in names) + ", target double")
        return model.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col("target")))).first()[0]
    bare = mae(None)
    for c in names:
        assert got[c].mae == pytest.approx(mae(c), rel=1e-9)
        assert got[c].importance == pytest.approx(mae(c) - bare, abs=1e-9)
    assert got["x0"].keep == 1 and got["x1"].keep == 1 and got["x0"].importance > got["x1"].importance > got["x2"].importance
    assert sum(r.share for r in got.values()) == pytest.approx(1)


def test_models_on_given_table(spark, sf_small):
    """No model is worse than the naive mean over the given table, and every forecast is there."""
    from tillroll.plans.catalog import queries
    skill = queries()["forecast_skill"](spark, sf_small).toPandas()
    total = skill.assign(m=skill.mae_model * skill.n, b=skill.mae_base * skill.n).groupby("model")[["m", "b"]].sum()
    assert set(total.index) <= {"products", "styles"} and len(total)
    assert (total.m <= total.b).all(), total
    shares = queries()["feature_importance_rows"](spark, sf_small).toPandas()
    for _, own in shares.groupby("model"):
        own = own.sort_values("cum_importance")
        running = 0.0  # the kept set, by a loop over the features
        for row in own.itertuples():
            running += row.importance
            assert row.keep == int(running <= 0.98 + 1e-9) or abs(running - 0.98) < 1e-6
