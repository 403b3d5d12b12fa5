"""Co-purchase (basket) operators: J3, A4-A8, W2, W3, R3, R4, R5, F19.

Definitions
-----------
* An order is a (customer, day) pair.
* ``pair_cnt(a, b)`` is the number of *rows* of item ``b`` in orders that
  contain ``a`` (``b != a``).  With ``n(o, i)`` = rows of ``i`` in order
  ``o``: ``pair_cnt(a, b) = sum over o containing a of n(o, b)``.  It is not
  symmetric and confidence can exceed 1.
* ``item_order_cnt(a)`` = distinct orders containing ``a``; support divides
  it by all distinct orders of the prepared frame (null items included).
* Often partners are ranks ``skip_top+1 .. skip_top+n`` in the order
  (pair_cnt desc, partner asc); rare partners are the first ``n`` in the
  exact reverse order (pair_cnt asc, partner desc).  ``skip_top`` defaults
  to 1, the reference behaviour of skipping the top partner.

Plan
----
1. ``cells``: one row per (order, item) with its row count ``n``
   (map-side partial aggregation collapses repeated items early).  A
   window over the order key adds the basket size ``d`` and marks one cell
   per order (for the order count), so neither needs its own scan.
2. Pairs: self equi-join of the cells on the order key, each unordered
   pair once with both row counts (half the join output; both sides share
   one shuffle of the cells).  Orders with more
   than ``slice_pairs`` distinct items are salted: the left side is
   split by a hash of the item into ``ceil(d / slice_pairs)`` slices
   and the right side is replicated per slice, so one huge basket is spread
   over many tasks instead of one.
3. ``groupBy(item, partner)`` with partial aggregation.
4. Top-n / bottom-n partners with ``row_number`` filters, which Spark turns
   into a per-partition group limit before the exchange, so only a few rows
   per item travel and a popular item does not concentrate its partners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.ordered import one_row
from tillroll.session import materialise

ORDER_COLS = ("customer_id", "t_dat")
#: Pairs of an order that one slice of it makes at most, about.
SLICE_PAIRS = 1 << 20


def basket_cells(rows: DataFrame, item: str, order_cols=ORDER_COLS) -> DataFrame:
    """(order..., item, n): rows of each item in each order; null items dropped."""
    return (rows.where(F.col(item).isNotNull())
                .groupBy(*order_cols, item).agg(F.count(F.lit(1)).alias("n")))


def sized_cells(rows: DataFrame, item: str, order_cols=ORDER_COLS) -> DataFrame:
    """Cells of every order (a null item kept as its own cell) with
    ``_d`` = distinct non-null items of the order and ``_first`` marking one
    cell per order.

    The size is a partially aggregated count joined back, not a window, so
    a hot order is counted map-side and its cells can be split by adaptive
    skew handling.
    """
    cells = rows.groupBy(*order_cols, item).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col(c) for c in order_cols]
    sizes = cells.groupBy(*order_cols).agg(F.count(item).alias("_d"),
                                           F.min(F.struct(F.col(item).isNotNull(), item)).alias("_least"))
    right = sizes.select(*[F.col(c).alias(f"_o_{c}") for c in order_cols], "_d", "_least")
    same = F.lit(True)
    for c in order_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    first = F.struct(F.col(item).isNotNull(), item).eqNullSafe(F.col("_least"))
    return cells.join(right, same).select(*order, item, "n", "_d", first.alias("_first"))


def materialized_cells(rows: DataFrame, item: str, order_cols=ORDER_COLS,
                       materialize: bool = True) -> DataFrame:
    """:func:`sized_cells`, written once to the shared checkpoint folder.

    The report reads the cells in four branches (both join sides, the item
    counts and the order count).  Column pruning makes those branches
    different plans, so Spark cannot share one exchange and would scan and
    aggregate the input four times; a written table computes the cells once,
    keeps column pruning, and survives the loss of executors.
    """
    sized = sized_cells(rows, item, order_cols)
    if not materialize:
        return sized
    return materialise(sized, "cells")


def order_count_sized(sized: DataFrame) -> DataFrame:
    """One row: ``n_order`` = distinct orders of the prepared frame (null
    items included), read from :func:`sized_cells` (no second scan)."""
    return sized.where("_first").agg(F.count(F.lit(1)).alias("n_order"))


def item_order_counts(cells: DataFrame, item: str) -> DataFrame:
    """A4: distinct orders per item (= cells per item)."""
    return cells.where(F.col(item).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("item_order_cnt"))


def item_support(rows: DataFrame, item: str, order_cols=ORDER_COLS, sized: DataFrame | None = None) -> DataFrame:
    """A4 + A5: (item, item_order_cnt, support)."""
    sized = sized if sized is not None else sized_cells(rows, item, order_cols)
    return (item_order_counts(sized, item).crossJoin(one_row(order_count_sized(sized)))
            .select(F.col(item), "item_order_cnt",
                    (F.col("item_order_cnt") / F.col("n_order")).alias("support")))


def pair_counts(cells: DataFrame, item: str, order_cols=ORDER_COLS,
                slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """J3 + A6: (item, partner, pair_cnt) over all co-occurring pairs.
    ``cells`` as from :func:`basket_cells` or :func:`sized_cells`."""
    sized = cells if "_d" in cells.columns else sized_cells_from(cells, item, order_cols)
    return pair_counts_sized(sized, item, order_cols, slice_pairs)


def sized_cells_from(cells: DataFrame, item: str, order_cols=ORDER_COLS) -> DataFrame:
    """Adds the basket size ``_d`` to cells built by :func:`basket_cells`, by a
    partially aggregated count that is joined back."""
    sizes = cells.groupBy(*[F.col(c).alias(f"_o_{c}") for c in order_cols]).agg(F.count(item).alias("_d"))
    same = F.lit(True)
    for c in order_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return cells.join(sizes, same).drop(*[f"_o_{c}" for c in order_cols])


def _slices(slice_pairs: int):
    d = F.col("_d").cast("double")
    return F.greatest(F.lit(1), F.ceil(d * d / F.lit(float(slice_pairs)))).cast("int")


def _sliced_left(cells: DataFrame, item: str, slice_pairs: int):
    return cells.withColumn("_slice", F.pmod(F.xxhash64(item), _slices(slice_pairs)).cast("int"))


def _sliced_right(cells: DataFrame, slice_pairs: int):
    return cells.withColumn("_slice", F.explode(F.sequence(F.lit(0), _slices(slice_pairs) - 1)))


def pair_counts_sized(sized: DataFrame, item: str, order_cols=ORDER_COLS,
                      slice_pairs: int = SLICE_PAIRS, items=None, carried: str | None = None) -> DataFrame:
    """Pairs from :func:`sized_cells`.

    Each unordered pair {a, b} of an order is joined once (``a < b``) and
    carries both row counts: ``n(o, b)`` adds to ``pair_cnt(a, b)`` and
    ``n(o, a)`` to ``pair_cnt(b, a)`` (both sums run over the orders holding
    a and b).  The two directions are split after the aggregation, so the
    join output and the pair shuffle are half of an ordered-pair join.

    ``items`` (list or one-column DataFrame) keeps only pairs whose first
    item is listed (reports for a few items); then ordered pairs are joined
    directly with the listed items on the left.

    ``carried`` names a column of the cells that is the same in all cells of
    an item; without ``items`` the pairs then hold it for both sides
    (``item_{carried}``, ``partner_{carried}``), so they need no join for it.
    """
    order_cols = list(order_cols)
    sized = sized.where(F.col(item).isNotNull())
    if items is not None:
        return _directed_pairs(sized, item, order_cols, slice_pairs, _restrict(sized, item, items))

    of = lambda side: [F.col(carried).alias(side)] if carried else []
    left = _sliced_left(sized, item, slice_pairs).select(
        *order_cols, "_slice", F.col(item).alias("item"), F.col("n").alias("_na"), *of("_ca"))
    right = _sliced_right(sized, slice_pairs).select(
        *order_cols, "_slice", F.col(item).alias("partner"), F.col("n").alias("_nb"), *of("_cb"))
    pairs = left.join(right, [*order_cols, "_slice"]).where(F.col("item") < F.col("partner"))
    same = [F.max(c).alias(c) for c in ("_ca", "_cb")] if carried else []
    half = pairs.groupBy("item", "partner").agg(F.sum("_nb").alias("_ab"), F.sum("_na").alias("_ba"), *same)

    def way(a, b, count, ca, cb):
        extra = [F.col(ca).alias(f"item_{carried}"), F.col(cb).alias(f"partner_{carried}")] if carried else []
        return F.struct(F.col(a).alias("item"), F.col(b).alias("partner"), F.col(count).alias("pair_cnt"), *extra)

    both = half.select(F.explode(F.array(way("item", "partner", "_ab", "_ca", "_cb"),
                                         way("partner", "item", "_ba", "_cb", "_ca"))).alias("_p"))
    return both.select("_p.*")


def _directed_pairs(sized: DataFrame, item: str, order_cols, slice_pairs: int, left_cells: DataFrame) -> DataFrame:
    """Ordered pairs (a, b), a from ``left_cells``, with the same slices."""
    left = _sliced_left(left_cells, item, slice_pairs).select(*order_cols, "_slice", F.col(item).alias("item"))
    right = _sliced_right(sized, slice_pairs).select(*order_cols, "_slice", F.col(item).alias("partner"), F.col("n").alias("_nb"))
    pairs = left.join(right, [*order_cols, "_slice"]).where(F.col("item") != F.col("partner"))
    return pairs.groupBy("item", "partner").agg(F.sum("_nb").alias("pair_cnt"))


def ranked_partners(pairs: DataFrame, n: int, skip_top: int = 1) -> DataFrame:
    """W2 + W3: (item, kind, rank, partner, pair_cnt) for the often ranks
    ``skip_top+1..skip_top+n`` and the ``n`` rarest partners."""
    w_often = Window.partitionBy("item").orderBy(F.col("pair_cnt").desc(), F.col("partner").asc())
    w_rare = Window.partitionBy("item").orderBy(F.col("pair_cnt").asc(), F.col("partner").desc())
    often = (pairs.withColumn("rank", F.row_number().over(w_often))
                  .where((F.col("rank") > skip_top) & (F.col("rank") <= skip_top + n))
                  .withColumn("rank", F.col("rank") - skip_top)
                  .withColumn("kind", F.lit("often")))
    rare = (pairs.withColumn("rank", F.row_number().over(w_rare))
                 .where(F.col("rank") <= n)
                 .withColumn("kind", F.lit("rare")))
    cols = ["item", "kind", "rank", "partner", "pair_cnt"]
    return often.select(*cols).unionByName(rare.select(*cols))


def partner_lists(ranked: DataFrame) -> DataFrame:
    """(item, often_purchased, often_counts, rare_purchased) as ordered arrays."""
    def ordered(kind, *fields):
        return F.array_sort(F.collect_list(
            F.when(F.col("kind") == kind, F.struct("rank", *fields))))
    agg = ranked.groupBy("item").agg(ordered("often", "partner", "pair_cnt").alias("_often"),
                                     ordered("rare", "partner").alias("_rare"))
    return agg.select(
        "item",
        F.transform("_often", lambda s: s["partner"]).alias("often_purchased"),
        F.transform("_often", lambda s: s["pair_cnt"]).alias("often_counts"),
        F.transform("_rare", lambda s: s["partner"]).alias("rare_purchased"),
    )


def _restrict(df: DataFrame, col: str, prods) -> DataFrame:
    if prods is None:
        return df
    if isinstance(prods, DataFrame):
        return df.join(prods.select(F.col(prods.columns[0]).alias(col)), col, "left_semi")
    return df.where(F.col(col).isin(list(prods)))


def co_purchase_report(rows: DataFrame, hierarchy: str = "prod_name", n: int = 3,
                       prods=None, skip_top: int = 1, slice_pairs: int = SLICE_PAIRS,
                       order_cols=ORDER_COLS, keep_counts: bool = False,
                       sort: bool = True, materialize: bool = True,
                       sized: DataFrame | None = None) -> DataFrame:
    """One row per item of column ``hierarchy``.

    Columns: ``items, item_order_cnt, often_purchased, rare_purchased,
    support, 1_freq_confidence .. n_freq_confidence`` sorted by support
    descending (ties by item).  ``prods`` (list or one-column DataFrame)
    restricts which items are reported, not the frame the counts use.
    Items with fewer partners get shorter arrays and null confidences.
    ``materialize`` checkpoints the cells once (see
    :func:`materialized_cells`); the call then runs that one job eagerly.
    """
    if sized is None:
        sized = materialized_cells(rows, hierarchy, order_cols, materialize)
    items = _restrict(item_order_counts(sized, hierarchy), hierarchy, prods) \
        .withColumnRenamed(hierarchy, "item")
    pairs = pair_counts_sized(sized, hierarchy, order_cols, slice_pairs, items=prods)
    lists = partner_lists(ranked_partners(pairs, n, skip_top))
    empty = F.array().cast("array<string>")
    report = (items.join(lists, "item", "left")
                   .crossJoin(one_row(order_count_sized(sized)))
                   .select(
                       F.col("item").alias("items"),
                       "item_order_cnt",
                       F.coalesce("often_purchased", empty).alias("often_purchased"),
                       F.coalesce("often_counts", F.array().cast("array<bigint>")).alias("often_counts"),
                       F.coalesce("rare_purchased", empty).alias("rare_purchased"),
                       (F.col("item_order_cnt") / F.col("n_order")).alias("support"),
                       "n_order"))
    conf = [(F.get(F.col("often_counts"), k - 1) / F.col("item_order_cnt")).alias(f"{k}_freq_confidence")
            for k in range(1, n + 1)]
    extra = ["often_counts", "n_order"] if keep_counts else []
    out = report.select("items", "item_order_cnt", "often_purchased", "rare_purchased",
                        "support", *conf, *extra)
    return out.orderBy(F.col("support").desc(), F.col("items")) if sort else out


def pair_metrics(rows: DataFrame, item: str = "prod_name", order_cols=ORDER_COLS,
                 slice_pairs: int = SLICE_PAIRS, materialize: bool = True) -> DataFrame:
    """A6-A8 for every pair: (item, partner, pair_cnt, confidence, lift).

    confidence = pair_cnt / item_order_cnt(item);
    lift = (pair_cnt / n_order) / (support(item) * support(partner)).
    """
    sized = materialized_cells(rows, item, order_cols, materialize)
    pairs = pair_counts_sized(sized, item, order_cols, slice_pairs)
    n_order = order_count_sized(sized)
    sup = (item_order_counts(sized, item).crossJoin(one_row(n_order))
           .select(F.col(item), "item_order_cnt", (F.col("item_order_cnt") / F.col("n_order")).alias("support")))
    a = sup.select(F.col(item).alias("item"), F.col("item_order_cnt").alias("_a_cnt"),
                   F.col("support").alias("_a_sup"))
    b = sup.select(F.col(item).alias("partner"), F.col("support").alias("_b_sup"))
    return (pairs.join(a, "item").join(b, "partner")
                 .crossJoin(one_row(n_order))
                 .select("item", "partner", "pair_cnt",
                         (F.col("pair_cnt") / F.col("_a_cnt")).alias("confidence"),
                         ((F.col("pair_cnt") / F.col("n_order")) / (F.col("_a_sup") * F.col("_b_sup"))).alias("lift")))


def partner_tops(rows: DataFrame, item: str = "prod_name", n: int = 3, order_cols=ORDER_COLS,
                 slice_pairs: int = SLICE_PAIRS, materialize: bool = True) -> DataFrame:
    """A6-A8 as bounded lists: per item the ``n`` partners of the highest count
    (``often``), the lowest (``rare``) and the highest lift (``lift``), with
    count, confidence and lift as in :func:`pair_metrics`.  Ties go to the
    smaller partner, in ``rare`` to the larger.

    The order counts of the items travel in the cells, so lift is known where
    the pairs are summed; each pair stands for all three lists there and is
    dropped before the shuffle unless it is among the ``n`` best of its task
    (a partial group limit).  No table of all pairs is shuffled by item or
    written.
    """
    sized = materialized_cells(rows, item, order_cols, materialize)
    counts = item_order_counts(sized, item)
    pairs = pair_counts_sized(sized.join(counts, item), item, order_cols, slice_pairs, carried="item_order_cnt")
    a, b, cnt = (F.col(c).cast("double") for c in ("item_item_order_cnt", "partner_item_order_cnt", "pair_cnt"))
    none = F.lit(None).cast(sized.schema[item].dataType)

    def entry(kind, value, up, down):
        return F.struct(F.lit(kind).alias("kind"), value.alias("_by"), up.alias("_up"), down.alias("_down"))

    lists = F.array(entry("often", -cnt, F.col("partner"), none), entry("rare", cnt, none, F.col("partner")),
                    entry("lift", -cnt / b, F.col("partner"), none))
    w = Window.partitionBy("item", "kind").orderBy("_by", "_up", F.col("_down").desc())
    best = pairs.select("*", F.explode(lists).alias("_l")).select("*", "_l.*") \
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    orders = F.col("n_order").cast("double")
    return best.crossJoin(one_row(order_count_sized(sized))).select(
        "item", "kind", F.col("rank").cast("bigint").alias("rank"), "partner", "pair_cnt",
        (cnt / a).alias("confidence"), ((cnt / orders) / ((a / orders) * (b / orders))).alias("lift"))


def co_purchase_detail(rows: DataFrame, articles: DataFrame, n: int = 3, names=None,
                       skip_top: int = 1, slice_pairs: int = SLICE_PAIRS,
                       order_cols=ORDER_COLS, materialize: bool = True) -> DataFrame:
    """R4 at product-name grain, for the items in ``names`` (all when None).

    Adds to R3: the item's (type, group) rows from the catalogue (one output
    row per distinct pair, metrics repeated on each), lift of each often
    partner, and the group and type of each often partner (the smallest when
    a name has several).
    """
    item = "prod_name"
    sized = materialized_cells(rows, item, order_cols, materialize)
    base = co_purchase_report(rows, item, n, names, skip_top, slice_pairs,
                              order_cols, keep_counts=True, sort=False, sized=sized)
    sup = item_support(rows, item, order_cols, sized=sized).select(
        F.col(item).alias("partner"), F.col("support").alias("_p_sup"))
    meta = (articles.where(F.col(item).isNotNull())
                    .groupBy(item).agg(F.min("product_group_name").alias("_p_group"),
                                       F.min("product_type_name").alias("_p_type"))
                    .withColumnRenamed(item, "partner"))
    exploded = base.select("items", "support", "n_order",
                           F.posexplode("often_purchased").alias("_k", "partner"),
                           F.col("often_counts"))
    per_partner = (exploded.join(sup, "partner", "left").join(meta, "partner", "left")
                   .select("items", "_k", "_p_group", "_p_type",
                           ((F.get(F.col("often_counts"), F.col("_k")) / F.col("n_order"))
                            / (F.col("_p_sup") * F.col("support"))).alias("_lift")))
    collected = (per_partner.groupBy("items")
                 .agg(F.array_sort(F.collect_list(F.struct("_k", "_lift", "_p_group", "_p_type"))).alias("_pp")))
    dim = (articles.select(item, "product_type_name", "product_group_name")
                   .where(F.col(item).isNotNull()).dropDuplicates()
                   .withColumnRenamed(item, "items"))
    out = base.join(collected, "items", "left").join(dim, "items", "left")
    conf = [f"{k}_freq_confidence" for k in range(1, n + 1)]
    lifts = [F.get(F.col("_pp"), k - 1)["_lift"].alias(f"{k}_freq_prod_lift") for k in range(1, n + 1)]
    return out.select(
        F.col("items").alias(item), "item_order_cnt", "often_purchased", "rare_purchased",
        "product_type_name", "product_group_name", *conf, "support", *lifts,
        F.coalesce(F.transform("_pp", lambda s: s["_p_group"]), F.array().cast("array<string>")).alias("often_purchased_group"),
        F.coalesce(F.transform("_pp", lambda s: s["_p_type"]), F.array().cast("array<string>")).alias("often_purchased_prod_types"),
    )
