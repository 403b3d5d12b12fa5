"""DuckDB SQL fragments: the same test-data mapping as
:mod:`tillroll.sources.testdata`, written once and reused by the oracles."""

from __future__ import annotations

TRANSACTIONS = """
SELECT CAST(o.o_orderdate AS DATE) AS t_dat,
       sha256(CAST(o.o_custkey AS VARCHAR)) AS customer_id,
       CAST(l.l_partkey AS INTEGER) AS article_id,
       CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DOUBLE) AS price,
       CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS sales_channel_id
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""

ARTICLES = """
SELECT CAST(p_partkey AS INTEGER) AS article_id,
       CAST(p_partkey // 10 AS INTEGER) AS product_code,
       p_name AS prod_name,
       CAST(ascii(p_type) * 100 + ascii(substr(p_type, 2, 1)) AS INTEGER) AS product_type_no,
       p_type AS product_type_name,
       p_brand AS product_group_name
FROM part
"""

GRID = """
SELECT p.p_name || '_' || p.p_type || '_' || p.p_brand AS style_color_group,
       p.p_name || '_' || p.p_type AS style_group,
       split_part(p.p_name, ' ', 2) AS level3,
       split_part(p.p_name, ' ', 1) AS level4,
       CAST(l.l_shipdate AS DATE) AS transaction_date,
       'online' AS sales_channel,
       CAST(l.l_quantity AS INTEGER) AS units_sold,
       p.p_retailprice AS original_price,
       p.p_retailprice AS sales_price,
       CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DOUBLE) AS final_price,
       CAST(l.l_discount > 0 AS INTEGER) AS is_promotion,
       strftime(CAST(l.l_shipdate AS DATE), '%Y-%m') AS month_of_launch,
       CAST(year(l.l_shipdate) AS VARCHAR) || '-Q' || CAST(quarter(l.l_shipdate) AS VARCHAR) AS current_season,
       CAST(year(l.l_shipdate) AS VARCHAR) || CASE WHEN month(l.l_shipdate) <= 6 THEN '-H1' ELSE '-H2' END AS initial_season,
       CAST(date_trunc('quarter', l.l_shipdate) AS DATE) AS season_start_date,
       CAST(last_day(date_trunc('quarter', l.l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS season_end_date
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

# Holidays by rule for each year of the grid (anonymous Gregorian Easter).
HOLIDAYS = """
SELECT h.holiday_date, h.holiday_name FROM (
  SELECT y, a, b, c, b // 4 AS d, b % 4 AS e, (b + 8) // 25 AS f FROM (
    SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c
    FROM (SELECT unnest(range(min(year(l_shipdate)), max(year(l_shipdate)) + 1)) AS y FROM lineitem))
) s0,
LATERAL (SELECT (s0.b - s0.f + 1) // 3 AS g) s1,
LATERAL (SELECT (19 * s0.a + s0.b - s0.d - s1.g + 15) % 30 AS h, s0.c // 4 AS i, s0.c % 4 AS k) s2,
LATERAL (SELECT (32 + 2 * s0.e + 2 * s2.i - s2.h - s2.k) % 7 AS l) s3,
LATERAL (SELECT (s0.a + 11 * s2.h + 22 * s3.l) // 451 AS m) s4,
LATERAL (SELECT make_date(CAST(s0.y AS INTEGER), CAST((s2.h + s3.l - 7 * s4.m + 114) // 31 AS INTEGER),
                          CAST((s2.h + s3.l - 7 * s4.m + 114) % 31 + 1 AS INTEGER)) AS easter) s5,
LATERAL (VALUES
  (make_date(CAST(s0.y AS INTEGER), 1, 1), 'New Year''s Day'),
  (make_date(CAST(s0.y AS INTEGER), 5, 1), 'Labour Day'),
  (make_date(CAST(s0.y AS INTEGER), 10, 3), 'German Unity Day'),
  (make_date(CAST(s0.y AS INTEGER), 12, 25), 'Christmas Day'),
  (make_date(CAST(s0.y AS INTEGER), 12, 26), 'Second Day of Christmas'),
  (CAST(s5.easter - INTERVAL 2 DAY AS DATE), 'Good Friday'),
  (CAST(s5.easter + INTERVAL 1 DAY AS DATE), 'Easter Monday'),
  (CAST(s5.easter + INTERVAL 39 DAY AS DATE), 'Ascension Day'),
  (CAST(s5.easter + INTERVAL 50 DAY AS DATE), 'Whit Monday')
) h(holiday_date, holiday_name)
UNION ALL
SELECT DATE '2017-10-31', 'Reformation Day'
WHERE 2017 BETWEEN (SELECT min(year(l_shipdate)) FROM lineitem) AND (SELECT max(year(l_shipdate)) FROM lineitem)
"""


def hex_key(col: str) -> str:
    """F1 in DuckDB: last 16 hex digits as a signed 64-bit integer."""
    u = f"('0x' || right({col}, 16))::UBIGINT"
    return (f"CAST(CASE WHEN {u} >= 9223372036854775808::UBIGINT "
            f"THEN {u}::HUGEINT - 18446744073709551616::HUGEINT ELSE {u}::HUGEINT END AS BIGINT)")


def r6(expr: str) -> str:
    """The rounding convention of :func:`tillroll.plans.registry.finish`."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), 6) AS DOUBLE)"


def with_ctes(body: str, *ctes: tuple[str, str]) -> str:
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {parts}\n{body}"


BASE = {
    "transactions": TRANSACTIONS,
    "articles": ARTICLES,
    "grid": GRID,
    "holidays": HOLIDAYS,
}


def base(*names: str) -> list[tuple[str, str]]:
    return [(n, BASE[n]) for n in names]


def tx_keyed() -> tuple[str, str]:
    return ("tx", f"SELECT t_dat, {hex_key('customer_id')} AS customer_id, article_id, price FROM transactions")


def relative_keep(key: str, src: str, factor: float) -> str:
    """Keys with at least ``factor`` times the mean number of customers."""
    return f"""
        SELECT {key} FROM (SELECT {key}, nc, avg(nc) OVER () AS mean_nc FROM
          (SELECT {key}, count(DISTINCT customer_id) AS nc FROM {src} WHERE {key} IS NOT NULL GROUP BY {key}))
        WHERE nc >= {factor} * mean_nc"""


def prepared_basket(penetration: float = 0.0, min_cnt: int = 0, relative: float = 0.0) -> list[tuple[str, str]]:
    """R1 in SQL (expects transactions/articles CTEs)."""
    conds = []
    ctes = [tx_keyed()]
    if penetration > 0:
        ctes.append(("pen_keep", f"""
            SELECT article_id FROM
              (SELECT article_id, count(DISTINCT customer_id) AS nc FROM tx
               WHERE article_id IS NOT NULL GROUP BY article_id) x,
              (SELECT count(DISTINCT customer_id) AS tot FROM tx) y
            WHERE nc / tot >= {penetration}"""))
        conds.append("t.article_id IN (SELECT article_id FROM pen_keep)")
    if relative > 0:
        ctes.append(("rel_keep", relative_keep("article_id", "tx", relative)))
        conds.append("t.article_id IN (SELECT article_id FROM rel_keep)")
    if min_cnt > 1:
        ctes.append(("cnt_keep", f"""
            SELECT article_id FROM tx WHERE article_id IS NOT NULL
            GROUP BY article_id HAVING count(*) >= {min_cnt}"""))
        conds.append("t.article_id IN (SELECT article_id FROM cnt_keep)")
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    ctes.append(("prepared", f"""
        SELECT t.t_dat, t.customer_id, t.article_id, a.product_code, a.prod_name,
               a.product_type_no, a.product_type_name, a.product_group_name,
               CAST(t.customer_id AS VARCHAR) || strftime(t.t_dat, '%Y-%m-%d') AS order_instance
        FROM tx t LEFT JOIN articles a ON t.article_id = a.article_id {where}"""))
    return ctes


def basket_stages(item: str) -> list[tuple[str, str]]:
    """cells, n_orders, item_orders, pairs over CTE ``prepared``."""
    return [
        ("cells", f"""SELECT customer_id, t_dat, {item} AS item, count(*) AS n FROM prepared
                      WHERE {item} IS NOT NULL GROUP BY customer_id, t_dat, {item}"""),
        ("n_orders", "SELECT count(*) AS n_order FROM (SELECT DISTINCT customer_id, t_dat FROM prepared)"),
        ("item_orders", "SELECT item, count(*) AS item_order_cnt FROM cells GROUP BY item"),
        ("pairs", """SELECT a.item AS item, b.item AS partner, CAST(sum(b.n) AS BIGINT) AS pair_cnt
                     FROM cells a JOIN cells b ON a.customer_id = b.customer_id AND a.t_dat = b.t_dat
                     AND a.item <> b.item GROUP BY a.item, b.item"""),
        ("ranked", """SELECT *, row_number() OVER (PARTITION BY item ORDER BY pair_cnt DESC, partner ASC) AS rn_often,
                             row_number() OVER (PARTITION BY item ORDER BY pair_cnt ASC, partner DESC) AS rn_rare
                      FROM pairs"""),
    ]


def basket_report_sql(item: str, n: int, skip_top: int = 1, penetration: float = 0.0,
                      min_cnt: int = 0, prods: list[str] | None = None) -> str:
    conf_cols = ",\n".join(
        f"CAST(round(CAST(max(CASE WHEN rn_often = {skip_top + k} THEN pair_cnt END) / max(io.item_order_cnt) AS DECIMAL(38,10)), 6) AS DOUBLE) AS \"{k}_freq_confidence\""
        for k in range(1, n + 1))
    restrict = ""
    if prods is not None:
        lst = ", ".join("'" + p.replace("'", "''") + "'" for p in prods)
        restrict = f"WHERE io.item IN ({lst})"
    ctes = base("transactions", "articles") + prepared_basket(penetration, min_cnt) + basket_stages(item) + [
        ("often", f"""SELECT r.item, string_agg(partner, '|' ORDER BY rn_often) AS often_purchased, {conf_cols}
                      FROM ranked r JOIN item_orders io ON r.item = io.item
                      WHERE rn_often > {skip_top} AND rn_often <= {skip_top + n} GROUP BY r.item"""),
        ("rare", f"""SELECT item, string_agg(partner, '|' ORDER BY rn_rare) AS rare_purchased
                     FROM ranked WHERE rn_rare <= {n} GROUP BY item"""),
    ]
    conf_sel = ", ".join(f'o."{k}_freq_confidence"' for k in range(1, n + 1))
    body = f"""
SELECT CAST(io.item AS VARCHAR) AS items, CAST(io.item_order_cnt AS BIGINT) AS item_order_cnt,
       coalesce(o.often_purchased, '') AS often_purchased,
       coalesce(r.rare_purchased, '') AS rare_purchased,
       CAST(round(CAST(io.item_order_cnt / n.n_order AS DECIMAL(38,10)), 6) AS DOUBLE) AS support, {conf_sel}
FROM item_orders io LEFT JOIN often o ON io.item = o.item LEFT JOIN rare r ON io.item = r.item
CROSS JOIN n_orders n {restrict}"""
    return with_ctes(body, *ctes)


def elimination_ctes(src: str, keep: str, k: int, name: str = "gj") -> list[tuple[str, str]]:
    """Gauss-Jordan elimination in SQL of the normal equations in ``src``
    (columns xx_i_j for i <= j and xy_i, all DOUBLE, and ``keep``): CTE
    ``{name}`` has b_i (coefficients), v_i (diagonal of the inverse) and
    ``regular``."""
    cell = lambda i, j: f"a_{i}_{j}"
    width = 2 * k + 1
    first = [f"xx_{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)]
    start = [f"{first[i * k + j]} AS {cell(i, j)}" if j < k else
             f"xy_{i} AS {cell(i, j)}" if j == k else
             f"CAST({int(j - k - 1 == i)} AS DOUBLE) AS {cell(i, j)}" for i in range(k) for j in range(width)]
    diagonal = [f"xx_{i}_{i} AS d_{i}" for i in range(k)]
    ctes = [(f"{name}_0", f"SELECT {keep}, true AS regular, {', '.join(diagonal)}, {', '.join(start)} FROM {src}")]
    ds = ", ".join(f"d_{i}" for i in range(k))
    for p in range(k):
        row = {j: f"({cell(p, j)} / CASE WHEN regular AND {cell(p, p)} > 1e-9 * d_{p} THEN {cell(p, p)} ELSE 1.0 END)"
               for j in range(width)}
        cells = [f"{row[j] if i == p else f'{cell(i, j)} - {cell(i, p)} * {row[j]}'} AS {cell(i, j)}"
                 for i in range(k) for j in range(width)]
        ctes.append((f"{name}_{p + 1}", f"SELECT {keep}, regular AND {cell(p, p)} > 1e-9 * d_{p} AS regular, {ds}, "
                                        f"{', '.join(cells)} FROM {name}_{p}"))
    out = [f"{cell(i, k)} AS b_{i}, {cell(i, k + 1 + i)} AS v_{i}" for i in range(k)]
    return ctes + [(name, f"SELECT {keep}, regular, {', '.join(out)} FROM {name}_{k}")]


def student_p(t: str, dof: str) -> str:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the
    finite series in the angle of t."""
    cos2, sine = f"({dof} / ({dof} + {t} * {t}))", f"(abs({t}) / sqrt({dof} + {t} * {t}))"
    even = (f"{sine} * list_sum(list_transform(range(0, CAST({dof} // 2 AS BIGINT)), lambda m: "
            f"exp(lgamma(m + 0.5) - lgamma(m + 1.0)) / sqrt(pi()) * pow({cos2}, m)))")
    odd = (f"2 / pi() * (atan(abs({t}) / sqrt({dof})) + {sine} * sqrt({cos2}) * coalesce(list_sum(list_transform("
           f"range(0, CAST(({dof} - 1) // 2 AS BIGINT)), lambda m: "
           f"exp(lgamma(m + 1.0) - lgamma(m + 1.5)) * sqrt(pi()) / 2 * pow({cos2}, m))), 0))")
    return f"1 - CASE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END"


def ols_ctes(design: str, group: str, ps: list[str]) -> list[tuple[str, str]]:
    """The no-intercept regressions of ``no_intercept_ols`` over CTE
    ``design`` (group, y, ps): CTE ``ols`` with one row per regressor.

    Each step takes one column's share out of the columns after it (modified
    Gram-Schmidt on the rows), which keeps the condition of the design."""
    k = len(ps)
    ctes = [("gs_0", f"SELECT {group}, " + ", ".join(
        f"CAST({c} AS DOUBLE) AS c_{i}, CAST({c} AS DOUBLE) AS o_{i}" for i, c in enumerate([*ps, "y"])) + f" FROM {design}")]
    for j in range(k):
        dots = ", ".join(f"sum(c_{j} * c_{i}) OVER (PARTITION BY {group}) AS d_{j}_{i}" for i in range(j, k + 1))
        ctes.append((f"dot_{j}", f"SELECT *, {dots} FROM gs_{j}"))
        less = ", ".join(f"c_{i} - d_{j}_{i} / CASE WHEN d_{j}_{j} > 0 THEN d_{j}_{j} ELSE 1 END * c_{j} AS c_{i}" for i in range(j + 1, k + 1))
        ctes.append((f"gs_{j + 1}", f"SELECT * REPLACE ({less}) FROM dot_{j}"))
    once = ", ".join(f"max(d_{j}_{i}) AS d_{j}_{i}" for j in range(k) for i in range(j, k + 1))
    ctes.append(("tri", f"SELECT {group}, count(*) AS n, sum(o_{k} * o_{k}) AS yy, sum(c_{k} * c_{k}) AS rest, "
                        + ", ".join(f"sum(o_{i} * o_{i}) AS xx_{i}" for i in range(k)) + f", {once} FROM gs_{k} GROUP BY {group}"))
    full = " AND ".join(f"d_{j}_{j} > 1e-9 * xx_{j}" for j in range(k))
    ctes.append(("unit", f"SELECT *, {full} AS regular, CASE WHEN rest > 1e-20 * yy THEN rest ELSE 0 END AS ssr, " + ", ".join(
        f"d_{j}_{i} / CASE WHEN d_{j}_{j} > 0 THEN d_{j}_{j} ELSE 1 END AS u_{j}_{i}" for j in range(k) for i in range(j + 1, k + 1)) + ", "
        + ", ".join(f"1.0::DOUBLE AS w_{j}_{j}" for j in range(k)) + " FROM tri"))
    for step in range(1, k):  # the inverse of the unit triangle, diagonal by diagonal
        ctes.append((f"inv_{step}", "SELECT *, " + ", ".join(
            f"-({' + '.join(f'u_{i}_{m} * w_{m}_{i + step}' for m in range(i + 1, i + step + 1))}) AS w_{i}_{i + step}"
            for i in range(k - step)) + f" FROM {f'inv_{step - 1}' if step > 1 else 'unit'}"))
    beta = [" + ".join(f"w_{i}_{j} * u_{j}_{k}" for j in range(i, k)) for i in range(k)]
    spread = [" + ".join(f"w_{i}_{j} * w_{i}_{j} / CASE WHEN d_{j}_{j} > 0 THEN d_{j}_{j} ELSE 1 END" for j in range(i, k)) for i in range(k)]
    rows = ", ".join(f"('{p}', {beta[i]}, {spread[i]})" for i, p in enumerate(ps))
    return ctes + [
        ("fit_rows", f"""SELECT {group}, r.regressor, CASE WHEN regular THEN r.b END AS coef, n, yy, ssr, regular,
                  CASE WHEN regular AND n > {k} THEN sqrt(ssr / (n - {k}) * r.v) END AS std_err
                  FROM {f'inv_{k - 1}' if k > 1 else 'unit'}, LATERAL (VALUES {rows}) r(regressor, b, v)"""),
        ("tested", f"SELECT *, CASE WHEN std_err > 0 THEN coef / std_err END AS t, CAST(n - {k} AS DOUBLE) AS dof FROM fit_rows"),
        ("ols", f"""SELECT {group}, regressor, {r6('coef')} AS coef, {r6('std_err')} AS std_err, {r6('t')} AS t_value,
                  {r6(f"CASE WHEN t IS NOT NULL THEN {student_p('t', 'dof')} END")} AS p_value, CAST(n AS BIGINT) AS n_obs,
                  {r6('CASE WHEN regular AND yy > 0 THEN 1 - ssr / yy END')} AS r2_uncentered FROM tested"""),
    ]
