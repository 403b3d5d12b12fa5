"""Registered queries: price statistics, sensitivity tables, correlations,
line fits, style labels, cross-price tables and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import elasticity, metrics, panel
from tillroll.operators.calendar_dim import with_holiday_flag
from tillroll.operators.prep import small_table
from tillroll.plans.panel_queries import _STYLE, style_panel
from tillroll.plans.registry import finish, query, tables
from tillroll.plans.sqlparts import ols_ctes, with_ctes

N_CROSS_PRICES = 8
N_L3_PRICES = 4

_SP = _STYLE + [("spl", "SELECT *, level3 || '_' || level4 AS l3_l4 FROM sp")]
_SEASON = """CASE WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer'
                  WHEN month IN (9, 10, 11) THEN 'autumn' WHEN month IN (12, 1, 2) THEN 'winter' END"""
_MONTH = [("bym", """SELECT l3_l4, CAST(month(transaction_date) AS INTEGER) AS month, max(units_sold) AS units_sold_max,
                            min(units_sold) AS units_sold_min, avg(units_sold) AS units_sold_mean,
                            avg(final_price) AS final_price_mean FROM spl GROUP BY ALL""")]
_BYPRICE = [("byp", """SELECT * FROM (SELECT l3_l4, CAST(round_even(final_price, 0) AS INTEGER) AS final_price_round,
                              max(units_sold) AS units_sold_max, min(units_sold) AS units_sold_min,
                              stddev_samp(units_sold) AS units_sold_std, avg(units_sold) AS units_sold_mean
                       FROM spl GROUP BY ALL) WHERE units_sold_std > 0""")]
_LABELS = ("style_lbl", """SELECT style_group, level3, level4, row_number() OVER (ORDER BY level3, level4, style_group) AS style_rank
                        FROM (SELECT DISTINCT level3, level4, style_group FROM sp)""")


def _by_day(spark, sf_dir):
    return elasticity.price_units_by_day(style_panel(spark, sf_dir))


@query("price_stats", with_ctes("""
SELECT style_group, CAST(round(CAST(max(final_price) AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_price_max, CAST(round(CAST(min(final_price) AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_price_min,
       CAST(round(CAST(stddev_samp(final_price) AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_price_std, CAST(round(CAST(avg(final_price) AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_price_mean
FROM sp GROUP BY style_group""", *_STYLE))
def price_stats(spark, sf_dir):
    return finish(elasticity.price_stats(style_panel(spark, sf_dir)))


@query("style_price_day", with_ctes("""
SELECT style_group, transaction_date, CAST(round(CAST(avg(final_price) AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_price_mean,
       CAST(sum(units_sold) AS BIGINT) AS units_sold_sum FROM sp GROUP BY ALL""", *_STYLE))
def style_price_day(spark, sf_dir):
    return finish(_by_day(spark, sf_dir))


@query("sensitivity_holiday", with_ctes("""
SELECT level3 || '_' || level4 AS l3_l4, holiday_flag, CAST(max(units_sold) AS BIGINT) AS units_sold_max,
       CAST(min(units_sold) AS BIGINT) AS units_sold_min, CAST(round(CAST(avg(units_sold) AS DECIMAL(38,10)), 6) AS DOUBLE) AS units_sold_mean,
       CAST(round(CAST(avg(final_price) AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_price_mean, max(season_start_date) AS season_start_date_max,
       max(season_end_date) AS season_end_date_max
FROM (SELECT p.*, CAST(h.holiday_date IS NOT NULL AS INTEGER) AS holiday_flag FROM sps p
      LEFT JOIN (SELECT DISTINCT holiday_date FROM holidays) h ON p.transaction_date = h.holiday_date)
GROUP BY ALL""", *_STYLE, ("sps", """SELECT level3, level4, style_group, transaction_date, avg(final_price) AS final_price,
                                            sum(units_sold) AS units_sold, max(season_start_date) AS season_start_date,
                                            max(season_end_date) AS season_end_date FROM grid
                                     WHERE style_group IS NOT NULL AND transaction_date IS NOT NULL GROUP BY ALL""")))
def sensitivity_holiday(spark, sf_dir):
    t = tables(spark, sf_dir)
    p = panel.daily_style_panel(t.transaction_grid, carry_max=("season_start_date", "season_end_date"))
    return finish(elasticity.sensitivity_by_holiday(with_holiday_flag(p, "transaction_date", t.holidays)))


@query("sensitivity_month", with_ctes("""
SELECT l3_l4, month, strftime(make_date(2000, month, 1), '%b') AS month_name, CAST(units_sold_max AS BIGINT) AS units_sold_max,
       CAST(units_sold_min AS BIGINT) AS units_sold_min, CAST(round(CAST(units_sold_mean AS DECIMAL(38,10)), 6) AS DOUBLE) AS units_sold_mean,
       CAST(round(CAST(final_price_mean AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_price_mean FROM bym""", *_SP, *_MONTH))
def sensitivity_month(spark, sf_dir):
    return finish(elasticity.sensitivity_by_month(style_panel(spark, sf_dir))).orderBy("l3_l4", "month")


@query("sensitivity_price", with_ctes("""
SELECT l3_l4, final_price_round, CAST(units_sold_max AS BIGINT) AS units_sold_max, CAST(units_sold_min AS BIGINT) AS units_sold_min,
       CAST(round(CAST(units_sold_std AS DECIMAL(38,10)), 6) AS DOUBLE) AS units_sold_std, CAST(round(CAST(units_sold_mean AS DECIMAL(38,10)), 6) AS DOUBLE) AS units_sold_mean FROM byp""", *_SP, *_BYPRICE))
def sensitivity_price(spark, sf_dir):
    return finish(elasticity.sensitivity_by_price(style_panel(spark, sf_dir)))


@query("price_corr", with_ctes("""
SELECT l3_l4, CAST(round(CAST(round(CASE WHEN count(*) > 1 AND var_pop(final_price_round) > 0 AND var_pop(units_sold_mean) > 0 THEN corr(CAST(final_price_round AS DOUBLE), units_sold_mean) END * 100, 2) AS DECIMAL(38,10)), 6) AS DOUBLE) AS price_corr
FROM byp GROUP BY l3_l4""", *_SP, *_BYPRICE))
def price_corr(spark, sf_dir):
    return finish(elasticity.price_correlation(elasticity.sensitivity_by_price(style_panel(spark, sf_dir))))


@query("season_price", with_ctes(f"""
SELECT l3_l4, season, CAST(round(CAST(round(CASE WHEN count(*) > 1 AND var_pop(final_price_mean) > 0 AND var_pop(units_sold_mean) > 0 THEN corr(final_price_mean, units_sold_mean) END * 100, 2) AS DECIMAL(38,10)), 6) AS DOUBLE) AS price_corr,
       CAST(round(CAST(arg_max(final_price_mean, [revenue, final_price_mean]) AS DECIMAL(38,10)), 6) AS DOUBLE) AS best_price, CAST(round(CAST(max(revenue) AS DECIMAL(38,10)), 6) AS DOUBLE) AS max_revenue
FROM (SELECT *, {_SEASON} AS season, final_price_mean * units_sold_mean AS revenue FROM bym)
GROUP BY l3_l4, season""", *_SP, *_MONTH))
def season_price(spark, sf_dir):
    return finish(elasticity.seasonal_price(elasticity.sensitivity_by_month(style_panel(spark, sf_dir))))


@query("price_fit", with_ctes("""
SELECT style_group, CAST(round(CAST(regr_slope(y, x) AS DECIMAL(38,10)), 6) AS DOUBLE) AS slope, CAST(round(CAST(regr_intercept(y, x) AS DECIMAL(38,10)), 6) AS DOUBLE) AS intercept,
       CAST(round(CAST(regr_r2(y, x) AS DECIMAL(38,10)), 6) AS DOUBLE) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n
FROM (SELECT style_group, CAST(sum(units_sold) AS DOUBLE) AS y, avg(final_price) AS x FROM sp GROUP BY style_group, transaction_date)
GROUP BY style_group""", *_STYLE))
def price_fit(spark, sf_dir):
    return finish(elasticity.price_fit(_by_day(spark, sf_dir)))


@query("style_labels", with_ctes("""
SELECT style_group, level3, level4, 'style_' || CAST(style_rank AS VARCHAR) AS style_label,
       CAST(style_rank AS INTEGER) AS style_rank FROM style_lbl""", *_STYLE, _LABELS))
def style_labels(spark, sf_dir):
    return finish(elasticity.style_labels(style_panel(spark, sf_dir)))


@query("cross_price_wide", with_ctes("""
SELECT transaction_date, 'sales_price_style_' || CAST(style_rank AS VARCHAR) AS name,
       CAST(round(CAST(sales_price AS DECIMAL(38,10)), 6) AS DOUBLE) AS v FROM sp JOIN style_lbl USING (style_group)
UNION ALL
SELECT transaction_date, 'units_sold_style_' || CAST(style_rank AS VARCHAR) AS name, CAST(units_sold AS DOUBLE) AS v
FROM sp JOIN style_lbl USING (style_group)""", *_STYLE, _LABELS))
def cross_price_wide(spark, sf_dir):
    """The wide table, reported by its cells (its columns depend on the data)."""
    sp = small_table(style_panel(spark, sf_dir))
    labels = small_table(elasticity.style_labels(sp))
    return finish(metrics.long_form(elasticity.cross_price_wide(sp, labels), "transaction_date"))


# Units of each style on the daily mean sales prices of the 8 level3
# values (in name order); T19: log1p units of each l3_l4 on the daily mean
# final prices of the first 4 l3_l4 values.
_PRICES = ("prices", "SELECT transaction_date, " + ", ".join(
    f"max(CASE WHEN rk = {j} THEN price END) AS p_{j}" for j in range(1, N_CROSS_PRICES + 1))
    + " FROM (SELECT transaction_date, level3, avg(sales_price) AS price FROM sp GROUP BY ALL)"
    + " JOIN (SELECT level3, row_number() OVER (ORDER BY level3) AS rk FROM (SELECT DISTINCT level3 FROM sp)) USING (level3)"
    + f" WHERE rk <= {N_CROSS_PRICES} GROUP BY transaction_date"
    + " HAVING " + " AND ".join(f"p_{j} IS NOT NULL" for j in range(1, N_CROSS_PRICES + 1)))


def _cross_design(spark, sf_dir):
    # Targets, labels and prices all read the panel: materialise it once.
    sp = small_table(style_panel(spark, sf_dir))
    target = sp.join(elasticity.style_labels(sp).select("style_group", "style_label"), "style_group")
    prices = elasticity.ranked_prices(sp, "level3", price="sales_price")
    return elasticity.regression_design(target, prices, N_CROSS_PRICES, own="sales_price")


def _l3_design(spark, sf_dir):
    l3 = small_table(elasticity.l3_l4_panel(style_panel(spark, sf_dir)))
    prices = elasticity.ranked_prices(l3, "l3_l4", price="final_price")
    return elasticity.regression_design(l3.withColumnRenamed("l3_l4", "style_label"), prices, N_L3_PRICES,
                                        log_target=True)


@query("cross_price_complete", with_ctes("""
SELECT 'style_' || CAST(l.style_rank AS VARCHAR) AS style_label, CAST(count(*) AS BIGINT) AS n_complete
FROM sp JOIN style_lbl l USING (style_group) JOIN prices p USING (transaction_date)
WHERE sp.units_sold IS NOT NULL GROUP BY l.style_rank""", *_STYLE, _LABELS, _PRICES))
def cross_price_complete(spark, sf_dir):
    design = _cross_design(spark, sf_dir)
    return finish(design.groupBy("style_label").agg(F.count(F.lit(1)).alias("n_complete")))


_PS = [f"p_{j}" for j in range(1, N_CROSS_PRICES + 1)]
_CROSS_DESIGN = ("design", f"""SELECT 'style_' || CAST(l.style_rank AS VARCHAR) AS style_label, CAST(sp.units_sold AS DOUBLE) AS y,
       CAST(sp.sales_price AS DOUBLE) AS p_own, {', '.join('p.' + p for p in _PS)}
FROM sp JOIN style_lbl l USING (style_group) JOIN prices p USING (transaction_date) WHERE sp.units_sold IS NOT NULL""")
_L3_PS = [f"p_{j}" for j in range(1, N_L3_PRICES + 1)]
_L3 = [("l3p", """SELECT l3_l4, transaction_date, avg(final_price) AS final_price, sum(units_sold) AS units_sold
                  FROM spl GROUP BY l3_l4, transaction_date"""),
       ("l3_prices", "SELECT transaction_date, " + ", ".join(
           f"max(CASE WHEN rk = {j} THEN final_price END) AS p_{j}" for j in range(1, N_L3_PRICES + 1))
        + " FROM l3p JOIN (SELECT l3_l4, row_number() OVER (ORDER BY l3_l4) AS rk FROM (SELECT DISTINCT l3_l4 FROM l3p)) USING (l3_l4)"
        + f" WHERE rk <= {N_L3_PRICES} GROUP BY transaction_date HAVING "
        + " AND ".join(f"p_{j} IS NOT NULL" for j in range(1, N_L3_PRICES + 1))),
       ("design", f"""SELECT l3_l4 AS style_label, ln(1 + CAST(units_sold AS DOUBLE)) AS y, {', '.join('p.' + p for p in _L3_PS)}
                      FROM l3p JOIN l3_prices p USING (transaction_date) WHERE units_sold IS NOT NULL""")]


@query("own_cross_price", with_ctes("SELECT * FROM ols", *_STYLE, _LABELS, _PRICES, _CROSS_DESIGN,
                                    *ols_ctes("design", "style_label", ["p_own", *_PS])))
def own_cross_price(spark, sf_dir):
    return finish(elasticity.no_intercept_ols(_cross_design(spark, sf_dir), N_CROSS_PRICES, own=True))


@query("log_price_model", with_ctes("SELECT * FROM ols", *_SP, *_L3, *ols_ctes("design", "style_label", _L3_PS)))
def log_price_model(spark, sf_dir):
    return finish(elasticity.no_intercept_ols(_l3_design(spark, sf_dir), N_L3_PRICES))
