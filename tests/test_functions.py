import datetime as dt

from pyspark.sql import functions as F

from tillroll.functions import calendar, hex_tail_to_long, round_half_even
from tillroll.operators import features, panel, prep
from tillroll.operators.calendar_dim import holiday_table


def test_hex_keys(spark):
    df = spark.createDataFrame([("abc" + "f" * 16,), ("abc" + "0" * 15 + "a",)], "c string")
    got = [r[0] for r in df.select(hex_tail_to_long("c")).collect()]
    assert got == [-1, 10]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(round_half_even("x")).collect()] == [0.0, 2.0, 2.0, -0.0]


def test_week_edges(spark):
    df = spark.createDataFrame([("k", dt.date(2020, 1, 5), 1), ("k", dt.date(2020, 1, 6), 2),
                                ("k", dt.date(2020, 1, 20), 4)], "key string, d date, v long")
    got = {r["week_end"]: r["v"] for r in panel.weekly_sales(df, "key", "d", "v").collect()}
    assert got == {dt.date(2020, 1, 5): 1, dt.date(2020, 1, 12): 2, dt.date(2020, 1, 19): 0,
                   dt.date(2020, 1, 26): 4}


def test_deciles(spark):
    df = spark.createDataFrame([(v,) for v in [0.1, 0.19, 0.1901, 0.5, 1.0]], "x double")
    got = [r["decile"] for r in prep.with_deciles(df, "x", "decile").orderBy("x").collect()]
    assert got == [1, 1, 2, 5, 10]


def test_centred_ma(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(200)], "k string, t int, y double")
    out = {r["t"]: r["ma"] for r in df.select(
        "t", features.centred_moving_average("y", "k", "t", 52, 26).alias("ma")).collect()}
    assert out[0] == 12.5 and out[100] == 99.5 and out[199] == 186.0


def test_date_parts_and_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2020, 3, 31),), (dt.date(2019, 1, 1),)], "d date")
    rows = df.select("d", *calendar.date_part_columns("d")).collect()
    r0, r1, r2 = rows
    assert r0["Week"] == 53 and r0["Dayofweek"] == 6 and r0["Year"] == 2021
    assert r1["Is_month_end"] == 1 and r1["Is_quarter_end"] == 1 and r1["Is_year_end"] == 0
    assert r2["Is_year_start"] == 1 and r2["Is_quarter_start"] == 1 and r2["Dayofweek"] == 1
    assert r2["Elapsed"] == 1546300800


def test_holidays_by_rule(spark):
    df = spark.createDataFrame([(dt.date(2024, 6, 1),)], "d date")
    h = {r["holiday_name"]: r["holiday_date"] for r in holiday_table(df).collect()}
    assert h["Good Friday"] == dt.date(2024, 3, 29)
    assert h["Easter Monday"] == dt.date(2024, 4, 1)
    assert h["Ascension Day"] == dt.date(2024, 5, 9)
    assert h["Whit Monday"] == dt.date(2024, 5, 20)
    assert h["German Unity Day"] == dt.date(2024, 10, 3)
    assert len(h) == 9


def test_season_and_month(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    got = [r[0] for r in df.select(calendar.season_of_month("m")).collect()]
    assert got == ["winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer",
                   "autumn", "autumn", "autumn", "winter"]


def test_fourier_values(spark):
    import math
    df = spark.createDataFrame([(t,) for t in range(5)], "t int")
    rows = df.select(*calendar.fourier_columns(F.col("t"), 4, 2)).collect()
    assert abs(rows[1]["sin_4_1"] - 1.0) < 1e-12
    assert abs(rows[2]["cos_4_1"] + 1.0) < 1e-12
    assert abs(rows[1]["sin_4_2"] - math.sin(math.pi)) < 1e-12


def test_profile_moments_match_pandas(spark):
    import pandas as pd
    from tillroll.operators import explore
    vals = [1.0, 2.0, 2.0, 3.0, 7.0, 9.0, 4.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = explore.numeric_profile(df, ["x"]).first()
    s = pd.Series(vals, dtype="float64")
    assert abs(r["skewness"] - s.skew()) < 1e-12 and abs(r["kurtosis"] - s.kurt()) < 1e-12
    assert r["missing"] == 1 and r["n"] == 8 and r["distinct"] == 6


def test_describe_many_columns_in_one_pass(spark):
    import numpy as np
    import pandas as pd
    from tillroll.operators import explore
    rng = np.random.default_rng(2)
    n = 700
    d = pd.DataFrame({"a": rng.normal(0, 5, n), "b": np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, 9, n)),
                      "c": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(1, n)), "e": [None] * (n - 1) + [4.0], "f": [None] * n})
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in d.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, e double, f double").repartition(5)
    got = {r["column"]: r for r in explore.describe(df, list("abcef")).collect()}
    for c in "abce":
        want = d[c].astype(float).describe()
        for ours, theirs in [("count", "count"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("min", "min"), ("max", "max")]:
            assert got[c][ours] == want[theirs], (c, ours)
    assert got["f"]["count"] == 0 and got["f"]["p50"] is None
    plan = explore.exact_quantiles(df, list("abcef"), [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "ranged-" in plan  # the input is read once, for all columns; the rest reads its counts
    empty = explore.describe(df.limit(0), ["a", "b"]).collect()
    assert [r["count"] for r in empty] == [0, 0] and empty[0]["p25"] is None


def test_describe_matches_pandas(spark):
    import pandas as pd
    from tillroll.operators import explore
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = explore.describe(df, ["x"]).first()
    d = pd.Series(vals).describe()
    for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert abs(r[ours] - d[theirs]) < 1e-12, ours
