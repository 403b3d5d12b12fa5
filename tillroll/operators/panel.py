"""Sales panels and supervised-learning layouts (A11, A12, A22, A23, W6-W9,
W11, T6).

Every window here is partitioned by a series key and runs over a *daily
panel* (one row per key and active day), so the size of a window partition
is bounded by the number of days in the history, not by the number of
transactions: a product with a third of all sales still has one row per
day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.calendar import week_ending_sunday


def daily_sales(rows: DataFrame, key: str = "product_code", date: str = "t_dat",
                price: str = "price", fill_gaps: bool = False) -> DataFrame:
    """A11 (+ A23 when ``fill_gaps``): per (key, day) the row count ``sales``
    and mean ``price``; output ``(key, date, sales, price)``.

    Without ``fill_gaps`` only active days appear (the reference's resample
    followed by an inner join on the price frame, N4).  With it, every day
    between the key's first and last day appears, empty days with sales 0
    and null price.
    """
    daily = (rows.where(F.col(key).isNotNull())
                 .groupBy(key, F.col(date).alias("date"))
                 .agg(F.count(F.lit(1)).alias("sales"), F.avg(price).alias("price")))
    if not fill_gaps:
        return daily
    return gap_fill(daily, key, "date", {"sales": F.lit(0).cast("bigint")})


def gap_fill(panel: DataFrame, key: str, date: str, defaults: dict, step_days: int = 1) -> DataFrame:
    """Calendar of each key from its first to last ``date`` (``sequence`` +
    ``explode``), left-joined to ``panel``; ``defaults`` fill the gaps."""
    span = panel.groupBy(key).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    cal = span.select(key, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step_days} DAY"))).alias(date))
    out = cal.join(panel, [key, date], "left")
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v))
    return out.select(*panel.columns)


def daily_style_panel(grid: DataFrame, carry_max=()) -> DataFrame:
    """Per (level3, level4, style_group, day) mean sales price, final
    price and promotion share, summed units; nulls filled with 0 (P15).
    ``carry_max`` columns (e.g. season dates) are carried as their maximum."""
    keys = ["level3", "level4", "style_group", "transaction_date"]
    out = (grid.where(F.col("style_group").isNotNull() & F.col("transaction_date").isNotNull())
               .groupBy(*keys)
               .agg(F.avg("sales_price").alias("sales_price"),
                    F.avg("final_price").alias("final_price"),
                    F.avg("is_promotion").alias("is_promotion"),
                    F.sum("units_sold").alias("units_sold"),
                    *[F.max(c).alias(c) for c in carry_max]))
    return out.fillna(0, subset=["sales_price", "final_price", "is_promotion", "units_sold"])


def weekly_sales(panel: DataFrame, key: str, date: str, value: str, out: str | None = None) -> DataFrame:
    """Weekly sums, weeks ending on Sunday, empty weeks between a key's
    first and last week reported as 0.  Output ``(key, week_end, out)``."""
    out = out or value
    weekly = (panel.groupBy(key, week_ending_sunday(date).alias("week_end"))
                   .agg(F.sum(value).alias(out)))
    zero = F.lit(0).cast(weekly.schema[out].dataType)
    return gap_fill(weekly, key, "week_end", {out: zero}, step_days=7)


def with_row_index(panel: DataFrame, key: str, date: str, out: str = "t") -> DataFrame:
    """1-based position of each row in its key's date order."""
    return panel.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(date)))


def temporal_split(panel: DataFrame, key: str, date: str, test_size: int = 14) -> DataFrame:
    """The last ``test_size`` rows of each key are ``test``; also adds
    ``day`` = 1..test_size for test rows (W11), null for train rows."""
    w_desc = Window.partitionBy(key).orderBy(F.col(date).desc())
    rn = F.row_number().over(w_desc)
    return (panel.withColumn("_rd", rn)
                 .withColumn("split", F.when(F.col("_rd") <= test_size, "test").otherwise("train"))
                 .withColumn("day", F.when(F.col("_rd") <= test_size, test_size + 1 - F.col("_rd")))
                 .drop("_rd"))


def lag_table(panel: DataFrame, key: str, date: str, value: str, lags: int = 30) -> DataFrame:
    """``lag_1 .. lag_{lags}`` of ``value`` over active-day rows."""
    w = Window.partitionBy(key).orderBy(date)
    return panel.select(key, date, value,
                        *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(1, lags + 1)])


def cv_folds(panel: DataFrame, key: str, date: str, initial: int = 30, window: int = 15,
             horizon: int = 1) -> DataFrame:
    """Sliding-window folds per key (1-based row positions ``t``).

    Fold 0 trains on rows 1..initial; fold f >= 1 trains on the ``window``
    rows ending at row initial+f.  Each fold tests the row ``horizon`` after
    its last training row.  Output ``(key, date, t, fold, role)``, one row
    per (row, fold) membership, generated with ``sequence`` + ``explode``.
    """
    idx = with_row_index(panel.select(key, date), key, date)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    idx = idx.withColumn("_n", n)
    last_fold = F.col("_n") - F.lit(initial + horizon)
    t = F.col("t")
    # Train folds containing row t: fold 0 if t <= initial, and folds f >= 1
    # with initial+f-window+1 <= t <= initial+f.
    lo = F.greatest(F.lit(1), t - F.lit(initial))
    hi = F.least(last_fold, t - F.lit(initial) + F.lit(window - 1))
    train_folds = F.concat(F.when(t <= initial, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                           F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")))
    test_fold = t - F.lit(initial + horizon)
    roles = F.concat(
        F.transform(train_folds, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
        F.when((test_fold >= 0) & (test_fold <= last_fold),
               F.array(F.struct(test_fold.cast("int").alias("fold"), F.lit("test").alias("role"))))
         .otherwise(F.array().cast("array<struct<fold:int,role:string>>")))
    return (idx.where(last_fold >= 0)
               .select(key, date, "t", F.explode(roles).alias("_r"))
               .select(key, date, "t", "_r.fold", "_r.role"))


def horizon_table(panel: DataFrame, key: str, date: str, value: str, lags: int = 30,
                  horizon: int = 14, exog=None, origin_cols=(), rebalance: bool = False) -> DataFrame:
    """T6 (direct strategy): one row per (key, origin row, h = 1..horizon).

    ``lag_1 .. lag_{lags}`` are the values at the origin and before it
    (``lag_1`` = value at the origin); ``target`` is the value ``h`` rows
    after the origin; ``exog`` columns are taken at the target row (known
    future prices); ``origin_cols`` are carried from the origin row.  Rows
    without a full lag window or target are dropped.  The coming rows are one
    array a row, made by one window frame whatever the number of ``exog``.
    ``rebalance`` lets AQE cut the origin rows into partitions before each
    becomes ``horizon`` rows.
    """
    exog = list(exog or [])
    origin_cols = list(origin_cols)
    w = Window.partitionBy(key).orderBy(date)
    base = panel.select(
        key, F.col(date).alias("origin_date"), *origin_cols,
        *[F.lag(value, k - 1).over(w).alias(f"lag_{k}") for k in range(1, lags + 1)],
        F.collect_list(F.struct(F.col(value).alias("target"), *exog)).over(w.rowsBetween(1, horizon)).alias("_hz"))
    base = base.where(F.col(f"lag_{lags}").isNotNull())
    out = (base.hint("rebalance") if rebalance else base).select(
        key, "origin_date", *origin_cols, *[f"lag_{k}" for k in range(1, lags + 1)], F.posexplode("_hz").alias("_h", "_z"))
    out = out.select(key, "origin_date", *origin_cols, (F.col("_h") + 1).alias("h"),
                     *[f"lag_{k}" for k in range(1, lags + 1)],
                     *[F.col(f"_z.{c}").alias(c) for c in exog], F.col("_z.target").alias("target"))
    return out.where(F.col("target").isNotNull())
