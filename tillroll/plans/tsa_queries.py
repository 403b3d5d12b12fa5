"""Registered queries: decomposition, detrending, periodogram, ADF."""

from __future__ import annotations

from tillroll.operators import panel, tsa
from tillroll.plans.panel_queries import _NAME_DAILY, name_daily
from tillroll.plans.registry import finish, query
from tillroll.plans.sqlparts import elimination_ctes, r6, with_ctes

WEEKLY_PERIOD = 52
DAILY_PERIOD = 90

_WEEKLY = _NAME_DAILY + [("wk", """
SELECT c.prod_name, c.week_end, CAST(coalesce(w.sales, 0) AS BIGINT) AS sales
FROM (SELECT prod_name, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
      FROM (SELECT prod_name, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_end FROM nd) GROUP BY prod_name) c
LEFT JOIN (SELECT prod_name, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_end, sum(sales) AS sales
           FROM nd GROUP BY ALL) w ON c.prod_name = w.prod_name AND c.week_end = w.week_end""")]


def _decompose_sql(src: str, date: str, value: str, period: int) -> list[tuple[str, str]]:
    w = f"OVER (PARTITION BY prod_name ORDER BY {date}"
    if period % 2:
        h = (period - 1) // 2
        trend = (f"CASE WHEN count({value}) {w} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {period} "
                 f"THEN avg({value}) {w} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) END")
    else:
        h = period // 2
        left = f"ROWS BETWEEN {h} PRECEDING AND {h - 1} FOLLOWING)"
        right = f"ROWS BETWEEN {h - 1} PRECEDING AND {h} FOLLOWING)"
        trend = (f"CASE WHEN count({value}) {w} {left} = {period} AND count({value}) {w} {right} = {period} "
                 f"THEN (avg({value}) {w} {left} + avg({value}) {w} {right}) / 2 END")
    return [
        ("dcb", f"""SELECT prod_name, {date}, {value}, {trend} AS trend,
                          (row_number() {w}) - 1) % {period} AS phase FROM {src}"""),
        ("dcp", f"SELECT prod_name, phase, avg({value} - trend) AS pm FROM dcb GROUP BY prod_name, phase"),
        ("dcs", "SELECT prod_name, phase, pm - avg(pm) OVER (PARTITION BY prod_name) AS seasonal FROM dcp"),
        ("dc", f"""SELECT b.prod_name, b.{date}, b.{value}, b.trend, s.seasonal, b.{value} - b.trend - s.seasonal AS resid
                   FROM dcb b LEFT JOIN dcs s ON b.prod_name = s.prod_name AND b.phase = s.phase"""),
    ]


def weekly_name_sales(spark, sf_dir):
    return panel.weekly_sales(name_daily(spark, sf_dir), "prod_name", "date", "sales")


@query("seasonal_parts", with_ctes(
    "SELECT prod_name, week_end, sales, CAST(round(CAST(trend AS DECIMAL(38,10)), 6) AS DOUBLE) AS trend, CAST(round(CAST(seasonal AS DECIMAL(38,10)), 6) AS DOUBLE) AS seasonal, "
    "CAST(round(CAST(resid AS DECIMAL(38,10)), 6) AS DOUBLE) AS resid FROM dc", *_WEEKLY, *_decompose_sql("wk", "week_end", "sales", WEEKLY_PERIOD)))
def seasonal_parts(spark, sf_dir):
    return finish(tsa.seasonal_decompose(weekly_name_sales(spark, sf_dir), "prod_name", "week_end",
                                         "sales", WEEKLY_PERIOD))


@query("deseasonalised", with_ctes(
    "SELECT prod_name, date, CAST(sales AS BIGINT) AS sales, CAST(round(CAST(seasonal AS DECIMAL(38,10)), 6) AS DOUBLE) AS seasonal, "
    "CAST(round(CAST(sales - seasonal AS DECIMAL(38,10)), 6) AS DOUBLE) AS deseasonalised FROM dc",
    *_NAME_DAILY, *_decompose_sql("nd", "date", "sales", DAILY_PERIOD)))
def deseasonalised(spark, sf_dir):
    return finish(tsa.deseasonalise(name_daily(spark, sf_dir), "prod_name", "date", "sales", DAILY_PERIOD))


_DETREND = [("dt0", "SELECT prod_name, date, sales, row_number() OVER (PARTITION BY prod_name ORDER BY date) AS t FROM nd"),
            ("dtf", """SELECT prod_name, regr_slope(CAST(sales AS DOUBLE), CAST(t AS DOUBLE)) AS slope,
                              regr_intercept(CAST(sales AS DOUBLE), CAST(t AS DOUBLE)) AS intercept FROM dt0 GROUP BY prod_name"""),
            ("dt", "SELECT d.*, f.slope, f.intercept, f.intercept + f.slope * d.t AS trend_fit FROM dt0 d JOIN dtf f USING (prod_name)")]


@query("detrended", with_ctes("""
SELECT prod_name, date, CAST(sales AS BIGINT) AS sales, CAST(t AS INTEGER) AS t, CAST(round(CAST(slope AS DECIMAL(38,10)), 6) AS DOUBLE) AS slope,
       CAST(round(CAST(intercept AS DECIMAL(38,10)), 6) AS DOUBLE) AS intercept, CAST(round(CAST(trend_fit AS DECIMAL(38,10)), 6) AS DOUBLE) AS trend_fit, CAST(round(CAST(sales - trend_fit AS DECIMAL(38,10)), 6) AS DOUBLE) AS detrended
FROM dt""", *_NAME_DAILY, *_DETREND))
def detrended(spark, sf_dir):
    return finish(tsa.linear_detrend(name_daily(spark, sf_dir), "prod_name", "date", "sales"))


@query("periodogram", with_ctes("""
SELECT r.prod_name, CAST(k AS INTEGER) AS k, CAST(round(CAST(365.0 * k / r.n AS DECIMAL(38,10)), 6) AS DOUBLE) AS frequency,
       CAST(round(CAST(CASE WHEN k = 0 OR 2 * k = r.n THEN 1.0 ELSE 2.0 END
             * (pow(sum(r.resid * cos(2 * pi() * k * r.t0 / r.n)), 2) + pow(sum(r.resid * sin(2 * pi() * k * r.t0 / r.n)), 2))
             / (CAST(r.n AS DOUBLE) * r.n) AS DECIMAL(38,10)), 6) AS DOUBLE) AS power
FROM (SELECT prod_name, sales - trend_fit AS resid, t - 1 AS t0, count(*) OVER (PARTITION BY prod_name) AS n FROM dt) r,
     LATERAL (SELECT unnest(range(0, r.n // 2 + 1)) AS k) ks
GROUP BY r.prod_name, k, r.n""", *_NAME_DAILY, *_DETREND))
def periodogram(spark, sf_dir):
    return finish(tsa.periodogram(name_daily(spark, sf_dir), "prod_name", "date", "sales"))


ADF_LAG = 1
_ADF_X = ["one", "lev", "d1", "dy"]
_ADF = [("adl", """SELECT prod_name, row_number() OVER w AS t, 1.0::DOUBLE AS one, CAST(lag(sales) OVER w AS DOUBLE) AS lev,
                          CAST(sales - lag(sales) OVER w AS DOUBLE) AS dy, CAST(lag(sales) OVER w - lag(sales, 2) OVER w AS DOUBLE) AS d1
                   FROM wk WINDOW w AS (PARTITION BY prod_name ORDER BY week_end)"""),
        ("adm", "SELECT prod_name, count(*) AS n, sum(dy * dy) AS yy, "
                + ", ".join(f"sum({a} * {b}) AS xx_{i}_{j}" for i, a in enumerate(_ADF_X[:3]) for j, b in enumerate(_ADF_X[:3]) if j >= i)
                + ", " + ", ".join(f"sum({a} * dy) AS xy_{i}" for i, a in enumerate(_ADF_X[:3]))
                + f" FROM adl WHERE t >= {ADF_LAG + 2} GROUP BY prod_name"),
        *elimination_ctes("adm", "prod_name, n, yy, xy_0, xy_1, xy_2", 3),
        ("adr", "SELECT *, greatest(yy - (0.0::DOUBLE + b_0 * xy_0 + b_1 * xy_1 + b_2 * xy_2), 0.0) / (n - 3) AS s2 FROM gj")]


@query("adf_stat", with_ctes("""
SELECT prod_name, CAST(round(CAST(CASE WHEN regular AND s2 * v_1 > 0 THEN b_1 / sqrt(s2 * v_1) END AS DECIMAL(38,10)), 6) AS DOUBLE) AS adf_stat,
       CAST(1 AS INTEGER) AS used_lag, CAST(n AS INTEGER) AS n_obs FROM adr""", *_WEEKLY, *_ADF))
def adf_stat(spark, sf_dir):
    """T2 at a fixed lag (which SQL can state); ``adf_search`` is the whole test."""
    out = tsa.adf_test(weekly_name_sales(spark, sf_dir), "prod_name", "week_end", "sales", ADF_LAG, autolag=False)
    return finish(out.select("prod_name", "adf_stat", "used_lag", "n_obs"))


def _normal_cdf_sql(x: str) -> str:
    """The normal distribution by the series of its density."""
    return (f"0.5 + sign({x}) * list_sum(list_transform(range(0, 400), lambda m: exp((2 * m + 1) * ln(greatest(abs({x}), 1e-300)) "
            f"- {x} * {x} / 2 - lgamma(2.0 * m + 2) + m * ln(2.0) + lgamma(m + 1.0)))) / sqrt(2 * pi())")


def _adf_design_sql(lags: str, level_last: bool) -> str:
    """Columns of the regression from list ``y`` of ``size`` values."""
    t = f"range({lags} + 2, size + 1)"
    level = f"[list_transform({t}, lambda t: y[t - 1])]"
    before = f"list_transform(range(1, {lags} + 1), lambda j: list_transform({t}, lambda t: y[t - j] - y[t - j - 1]))"
    order = [before, level] if level_last else [level, before]
    ends = f"[list_transform({t}, lambda t: 1.0::DOUBLE)]", f"[list_transform({t}, lambda t: y[t] - y[t - 1])]"
    return f"list_concat({', '.join([ends[0], *order, ends[1]])})"


def _adf_elimination_sql(name: str, source: str) -> tuple[str, str]:
    """One row per eliminated column j: its squared length, its product with
    the response, whether it is independent, and the response's residual."""
    own = "list_transform(cols, lambda c: list_inner_product(c, c))"
    return name, f"""
SELECT prod_name, 0 AS j, cols, {own} AS own, true AS live, 0.0::DOUBLE AS norm, 0.0::DOUBLE AS dot, 0.0::DOUBLE AS rest FROM {source}
UNION ALL
SELECT prod_name, j, cols, own, live, norm, dot,
       CASE WHEN list_inner_product(cols[-1], cols[-1]) > 1e-20 * own[-1] THEN list_inner_product(cols[-1], cols[-1]) ELSE 0 END
FROM (SELECT prod_name, j + 1 AS j, own, live, norm, list_inner_product(lead_col, after[-1]) AS dot,
             list_transform(list_transform(after, lambda c: {{'c': c, 'g': list_inner_product(c, lead_col) * CASE WHEN live THEN 1 / norm ELSE 0 END}}),
                            lambda z: list_transform(list_zip(z.c, lead_col), lambda v: v[1] - z.g * v[2])) AS cols
      FROM (SELECT *, norm > 1e-9 * own[j + 1] AS live
            FROM (SELECT prod_name, j, own, cols[1] AS lead_col, cols[2:] AS after, list_inner_product(cols[1], cols[1]) AS norm
                  FROM {name} WHERE len(cols) > 1)))"""


def _adf_search_sql() -> str:
    surface = ", ".join(f"{r6(f'{c0} + {c1} / n + {c2} / (n * n) + {c3} / (n * n * n)')} AS crit_{level[:-1]}pct"
                        for level, c0, c1, c2, c3 in tsa.ADF_CRITICAL_CONSTANT)
    low, high = ("(" + " + ".join(f"{c} * pow(stat, {i})" for i, c in enumerate(p)) + ")" for p in (tsa.ADF_P_LOW, tsa.ADF_P_HIGH))
    ctes = [
        *_WEEKLY,
        ("adfy", "SELECT prod_name, list(CAST(sales AS DOUBLE) ORDER BY week_end) AS y, count(*) AS size FROM wk GROUP BY prod_name"),
        ("adfc", "SELECT *, greatest(0, least(size // 2 - 2, CAST(ceil(12 * pow(size / 100.0, 0.25)) AS BIGINT))) AS cap FROM adfy"),
        ("adf1", f"SELECT prod_name, {_adf_design_sql('cap', False)} AS cols FROM adfc WHERE size >= cap + 4"),
        _adf_elimination_sql("adfe", "adf1"),
        ("adfa", """SELECT prod_name, j - 2 AS p, len(cols[-1]) * ln(CASE WHEN rest > 0 THEN rest / len(cols[-1]) ELSE 1e-300 END) + 2 * j AS aic
                    FROM adfe WHERE j >= 2"""),
        ("adfp", "SELECT prod_name, arg_min(p, (aic, p)) AS p FROM adfa GROUP BY prod_name"),
        ("adf2", f"SELECT prod_name, {_adf_design_sql('p', True)} AS cols FROM adfc JOIN adfp USING (prod_name)"),
        _adf_elimination_sql("adff", "adf2"),
        ("adft", """SELECT prod_name, max(len(cols[-1])) AS n, bool_and(live) AS live, max(j) AS k, arg_max(norm, j) AS norm, arg_max(dot, j) AS dot,
                           arg_max(rest, j) AS rest FROM adff GROUP BY prod_name"""),
        ("adfs", "SELECT *, CASE WHEN live AND rest > 0 AND n > k THEN dot / sqrt(norm * rest / (n - k)) END AS stat FROM adft"),
        ("adfx", f"SELECT *, CASE WHEN stat <= {tsa.ADF_P_SPLIT} THEN {low} ELSE {high} END AS x FROM adfs")]
    p_value = f"CASE WHEN stat > {tsa.ADF_P_MAX} THEN 1 WHEN stat < {tsa.ADF_P_MIN} THEN 0 ELSE {_normal_cdf_sql('x')} END"
    return with_ctes(f"""
SELECT prod_name, {r6('stat')} AS adf_stat, {r6(f'CASE WHEN stat IS NOT NULL THEN {p_value} END')} AS p_value,
       CAST(p AS INTEGER) AS used_lag, CAST(coalesce(n, 0) AS INTEGER) AS n_obs, {surface}
FROM adfc LEFT JOIN adfx USING (prod_name) LEFT JOIN adfp USING (prod_name)""", *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("adf_search", _adf_search_sql())
def adf_search(spark, sf_dir):
    """T2 in full: the lag chosen by AIC up to Schwert's bound, critical
    values and p-value."""
    return finish(tsa.adf_test(weekly_name_sales(spark, sf_dir), "prod_name", "week_end", "sales"))
