"""Preparation and eligibility filters.

Every filter is an aggregate followed by a ``left_semi`` join, so the
keep-list never leaves the cluster.  Scalar totals (all customers, all
sales) are one-row aggregates joined back with a cross join of one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.keys import hex_tail_to_long, order_instance
from tillroll.operators.ordered import one_row, running_sum_desc
from tillroll.session import materialise

ARTICLE_COLS = ["article_id", "product_code", "prod_name", "product_type_no",
                "product_type_name", "product_group_name"]


def customer_pairs(df: DataFrame, key: str, customer: str = "customer_id", value: str | None = None,
                   date: str | None = None) -> DataFrame:
    """One row per (key, customer), null keys included, written once: every
    per-key statistic and the number of all customers come from it, so the
    input is read in a single pass.  A key holding a third of all rows is
    combined map-side."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    if value:
        aggs.append(F.sum(F.col(value).cast("decimal(18,4)")).alias("_val"))
    if date:
        aggs += [F.min(date).alias("_lo"), F.max(date).alias("_hi")]
    return small_table(df.groupBy(key, customer).agg(*aggs))


def key_stats(pairs: DataFrame, key: str, customer: str = "customer_id") -> DataFrame:
    """Per non-null ``key`` of :func:`customer_pairs`: distinct customers
    (``n_customers``), rows (``n_rows``) and, where the pairs carry them, the
    summed value (``total_sales``, exact decimal) and first / last date."""
    aggs = [F.count(customer).alias("n_customers"), F.sum("_rows").alias("n_rows")]
    if "_val" in pairs.columns:
        aggs.append(F.sum("_val").alias("total_sales"))
    if "_lo" in pairs.columns:
        aggs += [F.min("_lo").alias("min_date"), F.max("_hi").alias("max_date")]
    return pairs.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def customer_total(pairs: DataFrame, customer: str = "customer_id") -> DataFrame:
    """One row: all distinct customers of :func:`customer_pairs` (those of
    null keys included)."""
    return pairs.agg(F.countDistinct(customer).alias("_all_customers"))


def mean_customers(stats: DataFrame) -> DataFrame:
    """One row: the mean number of customers over the keys of ``stats``."""
    return stats.agg(F.avg("n_customers").alias("_mean_customers"))


def penetration(df: DataFrame, key: str, customer: str = "customer_id") -> DataFrame:
    """A2: share of all distinct customers that bought each ``key``.

    Output ``(key, n_customers, penetration)``; null keys are dropped as a
    pandas group-by would, but their customers count in the denominator.
    """
    pairs = customer_pairs(df, key, customer)
    return (key_stats(pairs, key, customer).crossJoin(one_row(customer_total(pairs, customer)))
            .select(key, "n_customers",
                    F.try_divide(F.col("n_customers"), F.col("_all_customers")).alias("penetration")))


def eligible_by_penetration(df: DataFrame, key: str, threshold: float,
                            customer: str = "customer_id") -> DataFrame:
    """Keys whose penetration is at least ``threshold``."""
    return penetration(df, key, customer).where(F.col("penetration") >= threshold).select(key)


def eligible_by_relative_penetration(df: DataFrame, key: str, factor: float,
                                     customer: str = "customer_id") -> DataFrame:
    """P4/P5 without a scale: keys whose penetration is at least ``factor``
    times the mean penetration over all keys, so that about the same share
    of the keys stays however many customers there are."""
    stats = key_stats(customer_pairs(df, key, customer), key, customer)
    return (stats.crossJoin(one_row(mean_customers(stats)))
                 .where(F.col("n_customers") >= factor * F.col("_mean_customers")).select(key))


def row_counts(df: DataFrame, key: str, out: str = "counts") -> DataFrame:
    """A3: rows per key (value counts), null key dropped."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def eligible_by_min_count(df: DataFrame, key: str, min_cnt: int) -> DataFrame:
    """Keys with at least ``min_cnt`` rows."""
    return row_counts(df, key).where(F.col("counts") >= min_cnt).select(key)


def sales_share(df: DataFrame, key: str = "product_code", value: str = "price") -> DataFrame:
    """A9 + W1 + W4: total sales per key, cumulative share in descending
    order of sales (ties by key) and the ten equal-width bins of that share.

    The running sum runs per value range in parallel (no single-task global
    window); see :mod:`tillroll.operators.ordered`.
    """
    totals = (df.where(F.col(key).isNotNull())
                .groupBy(key).agg(F.sum(F.col(value).cast("decimal(18,4)")).alias("total_sales")))
    return share_of_totals(small_table(totals), key)


def small_table(df: DataFrame) -> DataFrame:
    """Write an aggregated table (one row per key, or per key and day) that
    several branches read, so the pass over the raw data that produced it
    runs once; the write is small next to that pass."""
    return materialise(df, "aggregate")


def share_of_totals(totals: DataFrame, key: str) -> DataFrame:
    """W1 + W4 over a per-key ``total_sales`` table."""
    cum = running_sum_desc(totals, "total_sales", key, "_cum")
    grand = totals.agg(F.sum("total_sales").alias("_grand"), F.max("total_sales").alias("_top"))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("_grand").cast("double"))
    shared = (cum.crossJoin(one_row(grand.select("_grand")))
                 .withColumn("cum_share", share("_cum")))
    # The sums are exact decimals, so the smallest share is the top key's
    # total over the grand total and the largest is exactly grand / grand:
    # the decile bounds come from the one-row totals, not a second pass.
    bounds = grand.select(share("_top").alias("_lo"), share("_grand").alias("_hi"))
    return with_deciles(shared.drop("_cum", "_grand"), "cum_share", "decile", bounds=bounds)


def with_deciles(df: DataFrame, value: str, out: str, bins: int = 10,
                 bounds: DataFrame | None = None) -> DataFrame:
    """``bins`` equal-width, right-closed bins between min and max of
    ``value`` (pandas ``cut(bins=10)``): bin = 1 + number of inner edges
    ``lo + i*width`` (i = 1..bins-1) strictly below the value, so the
    minimum falls in bin 1 and the maximum in bin ``bins``.  ``bounds`` (one
    row ``_lo, _hi``) can be given when they are known without a pass over
    ``df``."""
    if bounds is None:
        bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    above = [F.when(F.col(value) > F.lit(i) * width + F.col("_lo"), 1).otherwise(0) for i in range(1, bins)]
    binned = F.lit(1)
    for a in above:
        binned = binned + a
    return df.crossJoin(one_row(bounds)).withColumn(out, binned.cast("int")).drop("_lo", "_hi")


def top_share_keys(df: DataFrame, fraction: float, key: str = "product_code",
                   value: str = "price") -> DataFrame:
    """Keys whose cumulative sales share is at most ``fraction``."""
    return sales_share(df, key, value).where(F.col("cum_share") <= fraction).select(key)


def lifespan(df: DataFrame, key: str = "product_code", date: str = "t_dat") -> DataFrame:
    """A10: first and last day per key."""
    return (df.where(F.col(key).isNotNull())
              .groupBy(key).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date")))


def long_lived_keys(df: DataFrame, first_by, last_from, key: str = "product_code",
                    date: str = "t_dat") -> DataFrame:
    """Keys first seen on or before ``first_by`` and last seen on or after
    ``last_from`` (ISO date strings or dates)."""
    return (lifespan(df, key, date)
            .where((F.col("min_date") <= F.lit(first_by).cast("date"))
                   & (F.col("max_date") >= F.lit(last_from).cast("date")))
            .select(key))


def with_customer_key(transactions: DataFrame, customer: str = "customer_id") -> DataFrame:
    """F1/F2 at ingest: hex customer text -> int64, article id -> int32."""
    return (transactions.withColumn(customer, hex_tail_to_long(customer))
                        .withColumn("article_id", F.col("article_id").cast("int")))


def prepare_basket_rows(transactions: DataFrame, articles: DataFrame,
                        penetration_min: float = 0.0, min_cnt: int = 0,
                        convert_customer: bool = True, relative_penetration: float = 0.0) -> DataFrame:
    """Transactions joined to article metadata, restricted to eligible
    articles, with the printable ``order_instance`` key.

    Penetration and row counts are measured on the unfiltered transactions,
    both from one per-article statistics pass; ``relative_penetration`` is a
    threshold in units of the articles' mean penetration.  The keep-list is applied to
    the transactions before the article join (the result is the same: key
    and counts both come from transactions).
    """
    tx = transactions.select("t_dat", "customer_id", "article_id")
    if convert_customer:
        tx = with_customer_key(tx)
    keep = tx
    if penetration_min > 0 or min_cnt > 1 or relative_penetration > 0:
        pairs = customer_pairs(tx, "article_id")
        stats = key_stats(pairs, "article_id")
        cond = F.lit(True)
        if relative_penetration > 0:
            stats = stats.crossJoin(one_row(mean_customers(stats)))
            cond = cond & (F.col("n_customers") >= relative_penetration * F.col("_mean_customers"))
        if penetration_min > 0:
            stats = stats.crossJoin(one_row(customer_total(pairs)))
            cond = cond & (F.try_divide(F.col("n_customers"), F.col("_all_customers")) >= penetration_min)
        if min_cnt > 1:
            cond = cond & (F.col("n_rows") >= min_cnt)
        keep = keep.join(stats.where(cond).select("article_id"), "article_id", "left_semi")
    joined = keep.join(articles.select(*ARTICLE_COLS), "article_id", "left")
    return joined.select("t_dat", "customer_id", *ARTICLE_COLS,
                         order_instance("customer_id", "t_dat").alias("order_instance"))


def prepare_forecast_rows(transactions: DataFrame, articles: DataFrame,
                          cum_sales_fraction: float = 0.0, penetration_min: float = 0.0,
                          convert_customer: bool = True, first_by=None,
                          last_from=None, relative_penetration: float = 0.0) -> DataFrame:
    """R2 (+ P8): transactions + (product_code, prod_name), restricted to
    products with penetration >= ``penetration_min`` (and at least
    ``relative_penetration`` times the products' mean), then to products
    inside the top ``cum_sales_fraction`` of the remaining sales, then (when
    ``first_by`` / ``last_from`` are given) to products first sold on or
    before ``first_by`` and last sold on or after ``last_from``.  Zero
    thresholds mean no filter.

    Every decision is a product-level property, so all of them come from one
    per-product statistics pass (customers, sales, first and last day) and
    one semi join; the statistics table is checkpointed when the share's
    running sum reads it in several branches.
    """
    tx = transactions.select("t_dat", "customer_id", "article_id", "price")
    if convert_customer:
        tx = with_customer_key(tx)
    df = tx.join(articles.select("article_id", "product_code", "prod_name"), "article_id", "left")
    df = df.select("t_dat", "customer_id", "article_id", "price", "product_code", "prod_name")
    lifespan_filter = first_by is not None or last_from is not None
    if not (penetration_min > 0 or cum_sales_fraction > 0 or lifespan_filter or relative_penetration > 0):
        return df
    # The share alone needs the sales; without it the pass reads no prices.
    pairs = customer_pairs(df, "product_code", value="price" if cum_sales_fraction > 0 else None, date="t_dat")
    stats = key_stats(pairs, "product_code")
    if relative_penetration > 0:
        stats = (stats.crossJoin(one_row(mean_customers(stats)))
                      .where(F.col("n_customers") >= relative_penetration * F.col("_mean_customers"))
                      .drop("_mean_customers"))
    if penetration_min > 0:
        stats = (stats.crossJoin(one_row(customer_total(pairs)))
                      .where(F.try_divide(F.col("n_customers"), F.col("_all_customers")) >= penetration_min)
                      .drop("_all_customers"))
    if cum_sales_fraction > 0:
        stats = small_table(stats)
        shared = share_of_totals(stats.select("product_code", "total_sales"), "product_code")
        stats = stats.join(shared.where(F.col("cum_share") <= cum_sales_fraction).select("product_code"),
                           "product_code", "left_semi")
    if first_by is not None:
        stats = stats.where(F.col("min_date") <= F.lit(first_by).cast("date"))
    if last_from is not None:
        stats = stats.where(F.col("max_date") >= F.lit(last_from).cast("date"))
    return df.join(stats.select("product_code"), "product_code", "left_semi")


def eligible_counts(df: DataFrame, key: str) -> DataFrame:
    """Number of distinct eligible keys (one row)."""
    return df.agg(F.countDistinct(key).alias("n_eligible"))
