import datetime as dt
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tillroll.operators import basket, prep

D = dt.date(2020, 1, 1)


def rows_df(spark, rows):
    """rows: (customer, day offset, item)"""
    data = [(c, D + dt.timedelta(days=d), i) for c, d, i in rows]
    return spark.createDataFrame(data, "customer_id long, t_dat date, prod_name string")


def report(spark, rows, n=2, **kw):
    out = basket.co_purchase_report(rows_df(spark, rows), "prod_name", n, **kw).collect()
    return {r["items"]: r for r in out}


def test_ties_ordered_by_partner(spark):
    # a is bought with b, c, d once each: equal counts, order by name.
    rows = [(1, 0, "a"), (1, 0, "b"), (2, 0, "a"), (2, 0, "c"), (3, 0, "a"), (3, 0, "d")]
    r = report(spark, rows, n=2)["a"]
    assert r["often_purchased"] == ["c", "d"]          # rank 1 ("b") skipped
    assert r["rare_purchased"] == ["d", "c"]           # exact reverse order
    r0 = report(spark, rows, n=2, skip_top=0)["a"]
    assert r0["often_purchased"] == ["b", "c"]


def test_short_partner_lists(spark):
    rows = [(1, 0, "a"), (1, 0, "b")]
    r = report(spark, rows, n=3)["a"]
    assert r["often_purchased"] == [] and r["rare_purchased"] == ["b"]
    assert r["1_freq_confidence"] is None and r["3_freq_confidence"] is None


def test_repeated_item_counts_rows(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 0, "b"), (1, 0, "b"), (2, 0, "a"), (2, 0, "c")]
    r = report(spark, rows, n=1, skip_top=0)["a"]
    assert r["often_purchased"] == ["b"]
    assert r["1_freq_confidence"] == 1.5   # 3 rows of b / 2 orders of a
    assert r["item_order_cnt"] == 2


def test_null_item_counts_in_orders_only(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (2, 0, None)]
    out = report(spark, rows, n=1, skip_top=0)
    assert set(out) == {"a", "b"}
    assert out["a"]["support"] == 0.5        # 2 orders, one holds only a null item


def _brute_pairs(pdf):
    cnt = Counter()
    orders = defaultdict(Counter)
    for c, d, i in pdf.itertuples(index=False):
        if i is not None:
            orders[(c, d)][i] += 1
    for items in orders.values():
        for a in items:
            for b, nb in items.items():
                if a != b:
                    cnt[(a, b)] += nb
    return cnt


def test_pairs_match_brute_force_and_hot_path(spark, sf_small):
    from tillroll.plans.basket_queries import _prepared
    rows = _prepared(spark, sf_small).select("customer_id", "t_dat", "prod_name")
    want = _brute_pairs(rows.toPandas())
    cells = basket.basket_cells(rows, "prod_name")
    for hot in (1000, 2):   # 2 forces every basket through the salted path
        got = {(r["item"], r["partner"]): r["pair_cnt"]
               for r in basket.pair_counts(cells, "prod_name", slice_pairs=hot * hot).collect()}
        assert got == dict(want)


def test_pair_sum_property(spark, sf_small):
    from tillroll.plans.basket_queries import _prepared
    rows = _prepared(spark, sf_small).where(F.col("prod_name").isNotNull())
    cells = basket.basket_cells(rows, "prod_name")
    pairs = basket.pair_counts(cells, "prod_name").groupBy("item").agg(F.sum("pair_cnt").alias("s"))
    order_rows = cells.groupBy("customer_id", "t_dat").agg(F.sum("n").alias("rows_o"))
    rhs = (cells.join(order_rows, ["customer_id", "t_dat"])
                .groupBy(F.col("prod_name").alias("item")).agg(F.sum(F.col("rows_o") - F.col("n")).alias("s")))
    a = {r["item"]: r["s"] for r in pairs.collect()}
    b = {r["item"]: r["s"] for r in rhs.collect() if r["s"] > 0}
    assert a == b


def test_same_result_under_partitioning(spark, sf_small):
    from tillroll.plans.basket_queries import _prepared
    old = spark.conf.get("spark.sql.shuffle.partitions")
    res = []
    try:
        for p in ("1", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            df = basket.co_purchase_report(_prepared(spark, sf_small), "prod_name", 3)
            res.append(sorted(tuple(map(str, r)) for r in df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1]


def test_support_and_lift_bounds(spark, sf_small):
    from tillroll.plans.basket_queries import _prepared
    m = basket.pair_metrics(_prepared(spark, sf_small), "prod_name")
    agg = m.agg(F.min("lift"), F.min("confidence")).first()
    assert agg[0] >= 0 and agg[1] > 0
    s = basket.item_support(_prepared(spark, sf_small), "prod_name").agg(F.min("support"), F.max("support")).first()
    assert 0 < s[0] <= s[1] <= 1


def test_penetration_filter_uses_unfiltered_counts(spark):
    tx = spark.createDataFrame(
        [(D, "0" * 15 + "1", 1), (D, "0" * 15 + "2", 1), (D, "0" * 15 + "3", 2), (D, "0" * 15 + "1", 3)],
        "t_dat date, customer_id string, article_id int")
    art = spark.createDataFrame([(1, 10, "x", 1, "t", "g"), (2, 20, "y", 1, "t", "g"), (3, 30, "z", 1, "t", "g")],
                                "article_id int, product_code int, prod_name string, product_type_no int, "
                                "product_type_name string, product_group_name string")
    rows = prep.prepare_basket_rows(tx, art, penetration_min=0.5)
    assert sorted(r["article_id"] for r in rows.collect()) == [1, 1]
    assert rows.first()["order_instance"] in ("12020-01-01", "22020-01-01")


def test_hot_basket_holding_a_third_of_rows(spark):
    """One order holds a third of all rows (300 distinct items, repeated);
    with a small ``slice_pairs`` it is split into slices, and the
    result still equals the brute-force pair counts."""
    import random
    rnd = random.Random(7)
    rows = []
    for o in range(600):                       # normal orders: 2-6 items
        for _ in range(rnd.randint(2, 6)):
            rows.append((o, 0, f"i{rnd.randint(0, 299):03d}"))
    hot = [(10_000, 0, f"i{rnd.randint(0, 299):03d}") for _ in range(len(rows) // 2)]
    rows += hot
    df = rows_df(spark, rows)
    want = _brute_pairs(df.toPandas())
    cells = basket.basket_cells(df, "prod_name")
    got = {(r["item"], r["partner"]): r["pair_cnt"]
           for r in basket.pair_counts(cells, "prod_name", slice_pairs=2500).collect()}
    assert got == dict(want)
    rep = basket.co_purchase_report(df, "prod_name", 3, slice_pairs=2500).collect()
    rep2 = basket.co_purchase_report(df, "prod_name", 3).collect()
    assert sorted(map(str, rep)) == sorted(map(str, rep2))


def test_partner_tops_by_definition(spark):
    import random
    rng = random.Random(8)
    rows = [(c, d, rng.choice("abcdefgh")) for c in range(30) for d in range(2) for _ in range(rng.randint(1, 6))]
    rows += [(99, 0, f"x{k}") for k in range(40)]  # one wide order
    orders = defaultdict(Counter)
    for c, d, i in rows:
        orders[c, d][i] += 1
    held, pairs = Counter(), Counter()
    for o in orders.values():
        held.update(o.keys())
        for a in o:
            for b in o:
                if a != b:
                    pairs[a, b] += o[b]
    n_orders = len(orders)
    want = set()
    for item in held:
        own = [(b, n) for (a, b), n in pairs.items() if a == item]
        lists = {"often": sorted(own, key=lambda p: (-p[1], p[0])), "lift": sorted(own, key=lambda p: (-p[1] / held[p[0]], p[0])),
                 "rare": sorted(sorted(own, key=lambda p: p[0], reverse=True), key=lambda p: p[1])}
        want |= {(item, kind, k + 1, b, n, round(n / held[item], 9), round(n * n_orders / (held[item] * held[b]), 9))
                 for kind, ps in lists.items() for k, (b, n) in enumerate(ps[:3])}
    for limit in (1 << 20, 16):
        got = basket.partner_tops(rows_df(spark, rows), "prod_name", 3, slice_pairs=limit).collect()
        assert {(r.item, r.kind, r["rank"], r.partner, r.pair_cnt, round(r.confidence, 9), round(r.lift, 9)) for r in got} == want
        assert len(got) == len(want)
    assert basket.partner_tops(rows_df(spark, []), "prod_name", 3).count() == 0
