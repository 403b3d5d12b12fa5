"""Forecast evaluation and hierarchy roll-ups (T10-T12, T15, T17, A24-A27,
F14-F16, J7-J9) plus a seasonal-naive baseline forecast.

A backtest frame has one row per (key, day) with ``actual`` and
``forecast``; every metric is a grouped aggregate over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numeric import clamp_at_zero, round_half_even
from tillroll.operators.ordered import running_sum_desc

# Fixed value: float64 machine epsilon, the floor of the MAPE denominator.
FLOAT64_EPS = 2.220446049250313e-16

#: Keys of one block of a wide table.
BLOCK_KEYS = 256


def naive_forecast(panel: DataFrame, key: str, date: str, value: str,
                   test_size: int = 14, window: int = 14) -> DataFrame:
    """Baseline: the mean of the last ``window`` training rows, rounded half
    to even and clamped at 0, for each of the ``test_size`` test days.

    Output ``(key, day, date, actual, forecast)``.
    """
    # One window pass: the mean of the rows before the test rows, taken over
    # the whole key, next to the position from the end.
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col(date).desc()))
    recent = F.when((F.col("_rd") > test_size) & (F.col("_rd") <= test_size + window), F.col(value))
    rows = panel.select(key, date, value).withColumn("_rd", back) \
                .withColumn("_mean", F.avg(recent).over(Window.partitionBy(key)))
    return rows.where(F.col("_rd") <= test_size).select(
        key, (test_size + 1 - F.col("_rd")).cast("int").alias("day"), date, F.col(value).cast("double").alias("actual"),
        clamp_at_zero(round_half_even(F.col("_mean"))).cast("double").alias("forecast"))


def forecast_metrics(backtest: DataFrame, key: str, actual: str = "actual",
                     forecast: str = "forecast") -> DataFrame:
    """T10 + T11 + T12 per key.

    * ``mape``: mean |y - p| / max(|y|, eps) (plain MAPE, a ratio).
    * ``mape_smoothed``: mean |y - p| / (y + 0.1) x 100.
    * ``mae``: mean |y - p|.
    * ``smape``: mean |p - y| / ((|p| + |y| + 0.1) / 2) x 100, rounded to 2.
    """
    y, p = F.col(actual), F.col(forecast)
    err = F.abs(y - p)
    return backtest.groupBy(key).agg(
        F.avg(err / F.greatest(F.abs(y), F.lit(FLOAT64_EPS))).alias("mape"),
        (F.avg(err / (y + F.lit(0.1))) * 100).alias("mape_smoothed"),
        F.avg(err).alias("mae"),
        F.round(F.avg(err / ((F.abs(p) + F.abs(y) + F.lit(0.1)) / 2)) * 100, 2).alias("smape"),
    )


def mean_actual_vs_forecast(backtest: DataFrame, key: str, actual: str = "actual",
                            forecast: str = "forecast") -> DataFrame:
    """Mean actual and mean forecast per key."""
    return backtest.groupBy(key).agg(F.avg(actual).alias("mean_actual"),
                                     F.avg(forecast).alias("mean_forecast"))


def style_level_errors(actuals: DataFrame, forecasts: DataFrame, hierarchy: DataFrame,
                       key: str = "style_group", offset: float = 0.2) -> DataFrame:
    """J7 + J8 + F16: actual test rows left-joined to forecasts on
    (key, day) and to the hierarchy; absolute and percentage errors with
    ``offset`` added to the denominator."""
    joined = (actuals.join(forecasts, [key, "day"], "left")
                     .join(hierarchy, key, "left"))
    err = F.abs(F.col("units_sold") - F.col("forecast"))
    return joined.withColumn("abs_error", err) \
                 .withColumn("abs_percentage_error", err / (F.col("units_sold") + F.lit(offset)))


def overall_mape(errors: DataFrame) -> DataFrame:
    """Mean percentage error over all rows, x 100 (one row)."""
    return errors.agg((F.avg("abs_percentage_error") * 100).alias("overall_mape"))


def rollup(errors: DataFrame, level: str, period: str, actual: str = "units_sold",
           forecast: str = "forecast") -> DataFrame:
    """Sums of actual and forecast by (level, period) with
    absolute and percentage error (no denominator offset at this level;
    null when the actual sum is 0)."""
    agg = errors.groupBy(level, period).agg(F.sum(actual).cast("double").alias("actual"),
                                            F.sum(forecast).cast("double").alias("forecast"))
    err = F.abs(F.col("actual") - F.col("forecast"))
    return (agg.withColumn("abs_error", err)
               .withColumn("abs_percentage_error", F.try_divide(err, F.col("actual"))))


def with_week_of_horizon(df: DataFrame, day: str = "day", out: str = "week") -> DataFrame:
    """Week 1 for days 1-7 of the horizon, else week 2."""
    return df.withColumn(out, F.when(F.col(day) <= 7, 1).otherwise(2))


def wide_actual_prediction(backtest: DataFrame, key: str, day: str = "day", actual: str = "actual",
                           forecast: str = "forecast", keys=None, block_keys: int | None = None) -> DataFrame:
    """One row per horizon day, columns ``actual_{key}`` and
    ``prediction_{key}``.  The frame is first made long with a column-name
    value, then pivoted once over explicit names, so no pivot limit applies.
    ``keys`` names the columns; by default they are the distinct keys (the
    wide table has one pair of columns for each, so the list is as bounded as
    its header).  With ``block_keys`` the table comes in blocks of at most that
    many keys (:func:`wide_blocks`), and neither plan nor driver grows with
    the keys."""
    if block_keys:
        return wide_blocks(backtest, day, key, {"actual": actual, "prediction": forecast}, block_keys,
                           lambda c: F.first(c, ignorenulls=True))
    k = F.col(key).cast("string")
    long = backtest.select(
        day, F.explode(F.array(
            F.struct(F.concat(F.lit("actual_"), k).alias("name"), F.col(actual).cast("double").alias("v")),
            F.struct(F.concat(F.lit("prediction_"), k).alias("name"), F.col(forecast).cast("double").alias("v")),
        )).alias("_kv"))
    flat = long.select(day, F.col("_kv.name").alias("_name"), F.col("_kv.v").alias("_v"))
    if keys is None:
        keys = [r[0] for r in backtest.select(key).distinct().orderBy(key).collect()]
    names = [f"{kind}_{k}" for kind in ("actual", "prediction") for k in keys]
    return flat.groupBy(day).pivot("_name", names).agg(F.first("_v", ignorenulls=True))


def wide_blocks(long: DataFrame, row: str, key: str, values: dict, block_keys: int = BLOCK_KEYS, combine=F.sum) -> DataFrame:
    """A wide table for any number of keys, in blocks of at most ``block_keys``
    keys in key order: (block, ``row``, names, cells), where ``cells`` are the
    block's values of that row and ``names`` their columns ``{value}_{key}``.

    ``values`` maps the names of the values to their columns; ``combine`` makes
    one of repeated cells, null keys are left out.  The keys get their places
    by a distributed running count; no list of them reaches the driver, and
    the rows of one block have a bounded length.
    """
    keys = long.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct().withColumn("_one", F.lit(1))
    at = F.col("_at") - 1
    placed = running_sum_desc(keys, "_one", "_key", "_at").select(
        "_key", F.floor(at / block_keys).cast("int").alias("block"), F.pmod(at, F.lit(block_keys)).cast("int").alias("_slot"))
    heads = placed.groupBy("block").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_slot", F.col("_key").cast("string").alias("name")))), lambda s: s["name"]).alias("_names"))
    cells = long.join(placed, F.col(key) == F.col("_key")).groupBy("block", row, "_slot").agg(
        *[combine(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(values.values())])
    rows = cells.groupBy("block", row).agg(F.map_from_entries(F.collect_list(
        F.struct("_slot", F.struct(*[f"_v{i}" for i in range(len(values))])))).alias("_cells")).join(heads, "block")
    slots = F.sequence(F.lit(0), F.size("_names") - 1)
    named = lambda v: F.transform("_names", lambda n: F.concat(F.lit(f"{v}_"), n))
    held = lambda i: F.transform(slots, lambda k: F.try_element_at("_cells", k)[f"_v{i}"])
    return rows.select("block", row, F.concat(*[named(v) for v in values]).alias("names"),
                       F.concat(*[held(i) for i in range(len(values))]).alias("cells"))


def long_form(wide: DataFrame, row: str) -> DataFrame:
    """(row, name, v) of the cells that hold a value, of a wide table or of its
    blocks (:func:`wide_blocks`)."""
    if wide.columns == ["block", row, "names", "cells"]:
        return wide.select(row, F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("cells").alias("v"))).alias("_c")) \
            .select(row, "_c.name", "_c.v").where("v IS NOT NULL")
    values = [F.col(f"`{c}`") for c in wide.columns if c != row]
    return wide.unpivot(row, values, "name", "v").where("v IS NOT NULL")


def paired_skill(rows: DataFrame, key: str, model: str = "forecast", base: str = "naive", actual: str = "actual") -> DataFrame:
    """Paired comparison of two forecasts of the same days, per key: the days
    that have both (``n``), both mean absolute errors, the mean of the paired
    differences (negative: the model is better), their paired t statistic (null
    under two days or without spread) and whether the model is at least as
    good.  One aggregate; the sums are combined before the shuffle."""
    a, b = F.abs(F.col(model) - F.col(actual)), F.abs(F.col(base) - F.col(actual))
    both = rows.where(a.isNotNull() & b.isNotNull())
    out = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mae_model"), F.avg(b).alias("mae_base"),
                                F.avg(a - b).alias("mean_difference"), F.stddev_samp(a - b).alias("_sd"))
    t = F.when(F.col("_sd") > 0, F.col("mean_difference") / (F.col("_sd") / F.sqrt(F.col("n").cast("double"))))
    return out.withColumn("t_value", t).withColumn("as_good", (F.col("mean_difference") <= 0).cast("int")).drop("_sd")
