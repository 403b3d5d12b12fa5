"""Exploration: counts, inventories, profiles, histograms, rankings (A1,
A3, A13, A14, A28-A30, O3-O5, U2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.ordered import one_row, running_sum_desc


def distinct_counts(df: DataFrame, columns: dict[str, list[str]], exact: bool = True) -> DataFrame:
    """A1: one row of distinct counts, ``{name: [columns...]}``.

    Exact counts are one aggregate over one pass of ``df``: Spark copies
    each row once per distinct count (Expand) and de-duplicates every
    (count, value) pair in a single shuffle.  That beats one aggregate per
    count when ``df`` is itself a join that each pass would re-execute.
    ``exact=False`` uses HyperLogLog++ (``approx_count_distinct``): one
    pass, no shuffle of values, fixed memory per count.
    """
    if not exact:
        return df.agg(*[F.approx_count_distinct(F.struct(*cols) if len(cols) > 1 else F.col(cols[0])).alias(name)
                        for name, cols in columns.items()])
    return df.agg(*[F.countDistinct(*cols).alias(name) for name, cols in columns.items()])


def level_inventory(df: DataFrame, by: list[str], members: list[str]) -> DataFrame:
    """Per ``by`` group, the number and the sorted list of distinct
    values of each member column (lists are bounded by the catalogue)."""
    # Duplicates go before the shuffle: what is collected is the catalogue.
    distinct = df.where(F.col(by[0]).isNotNull()).select(*by, *members).dropDuplicates()
    lists = distinct.groupBy(*by).agg(*[F.array_sort(F.collect_set(m)).alias(f"{m}_unique") for m in members])
    cols = []
    for m in members:
        cols += [F.size(f"{m}_unique").cast("long").alias(f"{m}_nunique"), F.col(f"{m}_unique")]
    return lists.select(*by, *cols)


def date_range_by(df: DataFrame, key: str, date: str) -> DataFrame:
    """Row count, first and last date per key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(date).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass over ``df`` computing, per numeric column, rows,
    missing, zeros and their share, distinct values, mean, sample std, min,
    max, and the bias-corrected skewness and excess kurtosis (pandas'
    conventions, from Spark's population moments); unpivoted to one row per
    column."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(F.lit(1)).alias(f"{c}__n"), F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__missing"),
                 F.sum((x == 0).cast("long")).alias(f"{c}__zeros"), F.countDistinct(c).alias(f"{c}__distinct"),
                 F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.count(x).alias(f"{c}__k"), F.skewness(x).alias(f"{c}__g1"), F.kurtosis(x).alias(f"{c}__g2")]
    wide = df.agg(*aggs)

    def skew(c):
        k = F.col(f"{c}__k").cast("double")
        return F.when(k > 2, F.col(f"{c}__g1") * F.sqrt(k * (k - 1)) / (k - 2))

    def kurt(c):
        k = F.col(f"{c}__k").cast("double")
        return F.when(k > 3, ((k + 1) * F.col(f"{c}__g2") + 6) * (k - 1) / ((k - 2) * (k - 3)))

    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              *[F.col(f"{c}__{s}").alias(s) for s in
                                ("n", "missing", "zeros", "distinct", "mean", "std", "min", "max")],
                              skew(c).alias("skewness"), kurt(c).alias("kurtosis"))
                     for c in columns])
    long = wide.select(F.explode(rows).alias("r")).select("r.*")
    return long.withColumn("zero_share", F.try_divide(F.col("zeros").cast("double"), F.col("n").cast("double")))


def pairwise_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of numeric columns (one pass)."""
    from tillroll.operators.elasticity import safe_corr
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*[safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"{a}__{b}").alias("corr"))
                     for a, b in pairs])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """(column, q): the quantiles of every column that holds a value,
    interpolated linearly between neighbours, like pandas.

    One pass for all columns: the distinct (column, value) pairs are counted
    and ranked by one distributed running sum; a quantile reads the values
    that cover its two positions, so no buffer holds a column's values.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v"))
                                          for i, c in enumerate(columns)])).alias("x")).select("x.*")
    counts = cells.where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_sum_desc(counts, "i", "v", "cum", summed="c")
    # One row a column: its rows, and the rows ranked before its first.
    ends = ranked.groupBy("i").agg(F.sum("c").alias("n"), (F.max("cum") - F.sum("c")).alias("first"))
    before = F.col("cum") - F.col("first") - F.col("c")  # rows of the column with a smaller value
    parts, value = [], []
    for k, p in enumerate(probs):
        at = p * (F.col("n") - 1)
        parts += [F.max(F.when((before <= i) & (i < before + F.col("c")), F.col("v"))).alias(f"{end}{k}")
                  for end, i in (("lo", F.floor(at)), ("hi", F.ceil(at)))]
        value.append(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (at - F.floor(at)))
    found = ranked.join(F.broadcast(ends), "i").groupBy("i").agg(F.max("n").alias("n"), *parts)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return found.select(name.alias("column"), F.array(*value).alias("q"))


def describe(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per numeric
    column (``describe``).  Exact quartiles interpolate linearly like pandas;
    with ``exact=False`` they come from ``percentile_approx`` (one
    pass, fixed memory)."""
    aggs = []
    probs = [0.25, 0.5, 0.75]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
        if not exact:
            aggs.append(F.percentile_approx(x, probs, 10000).cast("array<double>").alias(f"{c}__q"))
    approximate = lambda c: F.lit(None).cast("array<double>") if exact else F.col(f"{c}__q")
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in ("count", "mean", "std", "min", "max")],
                              approximate(c).alias("q")) for c in columns])
    long = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    if exact:
        long = long.drop("q").join(exact_quantiles(df, columns, probs), "column", "left")
    return long.select("column", "count", "mean", "std", "min",
                       *[F.get("q", F.lit(k)).alias(name) for k, name in enumerate(("p25", "p50", "p75"))], "max")


def histogram(values: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram between min and max of ``value`` with
    numpy's edge rule (bin i holds edge_i <= x < edge_{i+1}, the last bin
    also holds the maximum) and density = count / (n * width).

    Output one row per bin, empty bins included.
    """
    x = F.col(value).cast("double")
    b = values.select(x.alias("_x")).where(F.col("_x").isNotNull())
    stats = b.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    edge = lambda i: F.col("_lo") + i * step
    guess = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("_x") - F.col("_lo"), step))).cast("int")
    j = F.coalesce(guess, F.lit(0))
    adj = (F.when(F.col("_x") < edge(j), j - 1)
            .when((j < bins - 1) & (F.col("_x") >= edge(j + 1)), j + 1)
            .otherwise(j))
    counted = b.crossJoin(one_row(stats)).withColumn("bin", adj).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    width = step
    return out.select("bin", edge(F.col("bin")).alias("bin_left"), edge(F.col("bin") + 1).alias("bin_right"),
                      F.col("count").cast("long").alias("count"),
                      F.try_divide(F.col("count").cast("double"), F.col("_n") * width).alias("density"))


def value_ranking(df: DataFrame, key: str) -> DataFrame:
    """A3 + O3: rows per key with the 1-based rank in (count desc, key)
    order.  The rank is an exact distributed running count."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("counts"))
    return running_sum_desc(counts.withColumn("_one", F.lit(1)), "counts", key, "rank", summed="_one").drop("_one")


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` keys with most rows (ties by key); the limit is
    the feature."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("counts"))
    return counts.orderBy(F.col("counts").desc(), F.col(key)).limit(k)
