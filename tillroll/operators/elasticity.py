"""Price sensitivity and elasticity (A15-A21, T16, T18-T21, W12, P12, P14,
F10-F12, F17, F18).

The own/cross price regressions do not loop over styles: every batch of rows
is reduced to one small triangular factor a style, the factors of a style are
merged after one shuffle, and the solves run a batch of styles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.calendar import month_abbr, season_of_month
from tillroll.functions.keys import l3_l4_key
from tillroll.functions.linear import fit_triangles, stacked_triangles, t_test_p
from tillroll.functions.numeric import round_half_even


def safe_corr(x, y):
    """Pearson correlation that is null (not an error under ANSI mode) when
    either side has no variance or fewer than two rows."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    # covar_pop / sqrt(var_pop * var_pop) equals ``corr``; try_divide keeps a
    # zero variance a null instead of an ANSI divide-by-zero error (the
    # built-in ``corr`` raises even when wrapped in a condition).
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.sqrt(F.var_pop(xs) * F.var_pop(ys)))


def price_stats(panel: DataFrame, key: str = "style_group", price: str = "final_price") -> DataFrame:
    """Max, min, sample std and mean price per key."""
    return panel.groupBy(key).agg(F.max(price).alias(f"{price}_max"), F.min(price).alias(f"{price}_min"),
                                  F.stddev_samp(price).alias(f"{price}_std"), F.avg(price).alias(f"{price}_mean"))


def price_units_by_day(panel: DataFrame, key: str = "style_group", date: str = "transaction_date",
                       price: str = "final_price", units: str = "units_sold") -> DataFrame:
    """Mean price and summed units per (key, day)."""
    return panel.groupBy(key, date).agg(F.avg(price).alias(f"{price}_mean"), F.sum(units).alias(f"{units}_sum"))


def with_l3_l4(panel: DataFrame) -> DataFrame:
    """composite ``l3_l4`` key."""
    return panel.withColumn("l3_l4", l3_l4_key())


def sensitivity_by_holiday(panel: DataFrame) -> DataFrame:
    """Per (l3_l4, holiday_flag) units max/min/mean, mean price and the
    latest season dates.  Expects ``holiday_flag`` and season date columns."""
    return with_l3_l4(panel).groupBy("l3_l4", "holiday_flag").agg(
        F.max("units_sold").alias("units_sold_max"), F.min("units_sold").alias("units_sold_min"),
        F.avg("units_sold").alias("units_sold_mean"), F.avg("final_price").alias("final_price_mean"),
        F.max("season_start_date").alias("season_start_date_max"),
        F.max("season_end_date").alias("season_end_date_max"))


def sensitivity_by_month(panel: DataFrame, date: str = "transaction_date") -> DataFrame:
    """A18 + F10 + O2: per (l3_l4, month) units max/min/mean and mean price,
    with the month abbreviation (the query that reports it sorts by
    (l3_l4, month))."""
    out = (with_l3_l4(panel).withColumn("month", F.month(date))
           .groupBy("l3_l4", "month").agg(
               F.max("units_sold").alias("units_sold_max"), F.min("units_sold").alias("units_sold_min"),
               F.avg("units_sold").alias("units_sold_mean"), F.avg("final_price").alias("final_price_mean")))
    name = month_abbr(F.make_date(F.lit(2000), F.col("month"), F.lit(1)))
    return out.withColumn("month_name", name)


def sensitivity_by_price(panel: DataFrame) -> DataFrame:
    """A19 + P12 + F14: per (l3_l4, price rounded half to even) units
    max/min/std/mean, keeping groups whose std is above 0."""
    out = (with_l3_l4(panel)
           .withColumn("final_price_round", round_half_even("final_price").cast("int"))
           .groupBy("l3_l4", "final_price_round").agg(
               F.max("units_sold").alias("units_sold_max"), F.min("units_sold").alias("units_sold_min"),
               F.stddev_samp("units_sold").alias("units_sold_std"), F.avg("units_sold").alias("units_sold_mean")))
    return out.where(F.col("units_sold_std") > 0)


def price_correlation(by_price: DataFrame, key: str = "l3_l4", price: str = "final_price_round",
                      units: str = "units_sold_mean") -> DataFrame:
    """Pearson correlation of price and mean units per key, x 100,
    rounded to 2 places."""
    return by_price.groupBy(key).agg(F.round(safe_corr(F.col(price).cast("double"), units) * 100, 2).alias("price_corr"))


def seasonal_price(by_month: DataFrame) -> DataFrame:
    """A21 + T21 + F11 + F18: per (l3_l4, season) the price-units
    correlation (x 100, 2 places), the best month price by revenue
    (price x mean units; ties to the higher price) and that revenue."""
    m = (by_month.withColumn("season", season_of_month(F.col("month")))
                 .withColumn("revenue", F.col("final_price_mean") * F.col("units_sold_mean")))
    return m.groupBy("l3_l4", "season").agg(
        F.round(safe_corr("final_price_mean", "units_sold_mean") * 100, 2).alias("price_corr"),
        F.max_by("final_price_mean", F.struct("revenue", "final_price_mean")).alias("best_price"),
        F.max("revenue").alias("max_revenue"))


def price_fit(by_day: DataFrame, key: str = "style_group", price: str = "final_price_mean",
              units: str = "units_sold_sum") -> DataFrame:
    """Least-squares line of units on price per key (slope,
    intercept, r^2)."""
    y, x = F.col(units).cast("double"), F.col(price).cast("double")
    return by_day.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                   F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def style_labels(panel: DataFrame, key: str = "style_group") -> DataFrame:
    """``style_{k}`` by first appearance in (level3, level4, key)
    order.

    The position is computed hierarchically: a row number inside each
    level3 group (in parallel across groups) plus the number of styles in
    the level3 groups before it, from a running sum over one row per level3
    value that is joined back.
    """
    styles = panel.select("level3", "level4", key).distinct()
    within = styles.withColumn("_r", F.row_number().over(Window.partitionBy("level3").orderBy("level4", key)))
    sizes = styles.groupBy("level3").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("level3", F.coalesce(
        F.sum("_size").over(Window.orderBy("level3").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    ranked = within.join(offsets, within["level3"].eqNullSafe(offsets["level3"])) \
        .select(within["level3"], "level4", key, (F.col("_r") + F.col("_off")).alias("style_rank"))
    return ranked.select(key, "level3", "level4",
                         F.concat(F.lit("style_"), F.col("style_rank").cast("string")).alias("style_label"),
                         F.col("style_rank").cast("int").alias("style_rank"))


def cross_price_wide(panel: DataFrame, labels: DataFrame, key: str = "style_group",
                     date: str = "transaction_date", names=None) -> DataFrame:
    """T16 (+ N21): date x style wide table with ``sales_price_{label}`` and
    ``units_sold_{label}``; (date, style) is unique in the panel, otherwise
    prices are averaged and units summed first.  ``names`` are the labels to
    give columns, by default all (one pair of columns each)."""
    per = (panel.groupBy(key, date).agg(F.avg("sales_price").alias("sales_price"), F.sum("units_sold").alias("units_sold"))
                .join(labels.select(key, "style_label"), key))
    long = per.select(date, F.explode(F.array(
        F.struct(F.concat(F.lit("sales_price_"), F.col("style_label")).alias("name"), F.col("sales_price").cast("double").alias("v")),
        F.struct(F.concat(F.lit("units_sold_"), F.col("style_label")).alias("name"), F.col("units_sold").cast("double").alias("v")),
    )).alias("_kv")).select(date, F.col("_kv.name").alias("_name"), F.col("_kv.v").alias("_v"))
    if names is None:
        names = [r[0] for r in labels.orderBy("style_rank").select("style_label").collect()]
    columns = [f"{kind}_{n}" for kind in ("sales_price", "units_sold") for n in names]
    return long.groupBy(date).pivot("_name", columns).agg(F.first("_v", ignorenulls=True))


def ranked_prices(panel: DataFrame, level: str, date: str = "transaction_date",
                  price: str = "sales_price") -> DataFrame:
    """Daily mean price per value of ``level`` with the value's rank in name
    order: ``(date, rank, price)``.  The rank is taken over the distinct
    values of ``level`` (a small dimension)."""
    daily = panel.groupBy(level, date).agg(F.avg(price).alias("price"))
    ranks = panel.select(level).distinct().withColumn("rank", F.row_number().over(Window.orderBy(level)))
    return daily.join(ranks, level).select(date, "rank", "price")


def regression_design(target: DataFrame, prices: DataFrame, n_prices: int,
                      group: str = "style_label", date: str = "transaction_date",
                      y: str = "units_sold", log_target: bool = False, own: str | None = None) -> DataFrame:
    """Complete-case rows ``(group, date, y, [p_own], p_1..p_k)``.

    ``prices`` holds ``(date, rank, price)``; p_j is the price ranked j on
    that date; ``own`` names the target's own price.  Only dates with all k
    prices are kept (``dropna``), and only rows where the regressed group has
    a value.
    """
    wide = (prices.where(F.col("rank") <= n_prices)
                  .groupBy(date).agg(*[F.max(F.when(F.col("rank") == j, F.col("price"))).alias(f"p_{j}")
                                       for j in range(1, n_prices + 1)]))
    complete = wide.dropna()
    yv = F.col(y).cast("double")
    if log_target:
        yv = F.log1p(yv)
    mine = [F.col(own).cast("double").alias("p_own")] if own else []
    kept = target.where(F.col(y).isNotNull())
    if own:
        kept = kept.where(F.col(own).isNotNull())
    return kept.select(group, date, yv.alias("y"), *mine).join(complete, date)


def _runs(table: pa.Table, group: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Group values of a table, a stable order of its rows by group, and the
    number of rows of each."""
    codes = table.column(group).combine_chunks().dictionary_encode("encode")
    index = codes.indices.to_numpy()
    return codes.dictionary, np.argsort(index, kind="stable"), np.bincount(index, minlength=len(codes.dictionary))


def triangular_rows(design: DataFrame, columns: list[str], group: str) -> DataFrame:
    """``design`` with each group's rows of a batch replaced by at most as many
    rows as there are columns that have the same inner products (their
    triangular factor); ``n`` counts the rows behind each.  Factors of factors
    are factors, so a group may lie in any number of tasks and steps."""
    c = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names, order, size = _runs(pa.Table.from_batches([b]), group)
            rows = np.stack([b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(c)], 1)[order]
            n = b.column(1 + c).to_numpy()[order]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            many = np.flatnonzero(size > c)
            few = np.repeat(size <= c, size)
            large = stacked_triangles(rows[~few], size[many]).reshape(-1, c)
            counts = np.zeros((len(many), c), np.int64)
            counts[:, 0] = np.add.reduceat(n, begin)[many]
            of = np.concatenate([np.repeat(np.arange(len(size)), size)[few], np.repeat(many, c)])
            out = np.concatenate([rows[few], large])
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(of)), *(pa.array(np.ascontiguousarray(x)) for x in out.T),
                 pa.array(np.concatenate([n[few], counts.ravel()]))], [group, *columns, "n"])

    schema = f"{group} string, " + ", ".join(f"{name} double" for name in columns) + ", n long"
    return design.mapInArrow(run, schema)


def no_intercept_ols(design: DataFrame, n_prices: int, group: str = "style_label", own: bool = False) -> DataFrame:
    """Per group, least squares ``y ~ [p_own +] p_1 + .. + p_k``
    without intercept.  Output ``(group, regressor, coef, std_err, t_value,
    p_value, n_obs, r2_uncentered)``; the estimates of a group whose
    regressors are linearly dependent are null.

    Moments would square the condition of the design, so the rows are reduced
    by orthogonal factors (a tall, narrow factorisation): every batch leaves
    one small triangle a group, the triangles of a group meet after one
    shuffle and are factored again, and the systems of a batch of groups are
    solved together.  A group that holds most rows is reduced before the
    shuffle like any other.
    """
    ps = ["p_own"] * own + [f"p_{j}" for j in range(1, n_prices + 1)]
    columns, k = [*ps, "y"], len(ps)
    rows = design.select(F.col(group).cast("string").alias(group), *[F.col(c).cast("double").alias(c) for c in columns],
                         F.lit(1).cast("long").alias("n"))
    schema = (f"{group} string, regressor string, coef double, std_err double, t_value double, p_value double, "
              "n_obs long, r2_uncentered double")

    def solved(held: pa.Table) -> pa.RecordBatch:
        names, order, size = _runs(held, group)
        m = np.stack([held.column(c).to_numpy() for c in columns], 1)[order]
        n = np.add.reduceat(held.column("n").to_numpy()[order], np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64))
        beta, inverse, ssr, yy, regular = fit_triangles(stacked_triangles(m, size))
        dof = n - k
        with np.errstate(divide="ignore", invalid="ignore"):
            sigma2 = np.where(dof > 0, ssr / dof, np.nan)
            se = np.sqrt(sigma2[:, None] * inverse)
            t = np.where(se > 0, beta / se, np.nan)
            r2 = np.where(yy > 0, 1 - ssr / yy, np.nan)
        p = t_test_p(t, dof[:, None] + np.zeros_like(t))
        keep = np.where(regular[:, None], 1.0, np.nan)
        each = np.repeat(np.arange(len(n)), k)
        numbers = [(x * keep).ravel() for x in (beta, se, t, p)]
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(each)), pa.array(ps * len(n)), *(pa.array(x, from_pandas=True) for x in numbers),
             pa.array(n[each]), pa.array((r2 * keep[:, 0])[each], from_pandas=True)],
            [f.split()[0] for f in schema.split(", ")])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last group so far: it may go on in the next batch
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = held.column(group)[held.num_rows - 1] if held.num_rows else None
            unnamed = last is None or not last.is_valid
            same = pc.is_null(held.column(group)) if unnamed else pc.fill_null(pc.equal(held.column(group), last), False)
            ended = held.filter(pc.invert(same))
            if ended.num_rows:
                yield solved(ended)
                held = held.filter(same)
        if held is not None and held.num_rows:
            yield solved(held)

    factors = triangular_rows(rows, columns, group)
    return factors.repartition(F.col(group)).sortWithinPartitions(group).mapInArrow(solve, schema)


def l3_l4_panel(panel: DataFrame, date: str = "transaction_date") -> DataFrame:
    """(l3_l4, date) mean final price and summed units (T19 input)."""
    return (with_l3_l4(panel).groupBy("l3_l4", date)
            .agg(F.avg("final_price").alias("final_price"), F.sum("units_sold").alias("units_sold")))
