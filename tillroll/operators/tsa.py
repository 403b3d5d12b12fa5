"""Time-series analysis per series key.

Decomposition, deseasonalising and detrending are window and aggregate
expressions.  The ADF regressions and the periodogram's transforms (one row per
series) run in numpy, a batch of series at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.linear import eliminate_in_order, normal_cdf


def _indexed(panel: DataFrame, key: str, order_col: str, out: str = "_t") -> DataFrame:
    return panel.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(order_col)))


def centred_trend(value: str, key: str, order_col: str, period: int):
    """Classical centred moving average of length ``period`` (a 2 x period
    average for even periods); null unless the whole window exists."""
    w = Window.partitionBy(key).orderBy(order_col)
    if period % 2 == 1:
        h = (period - 1) // 2
        frame = w.rowsBetween(-h, h)
        return F.when(F.count(value).over(frame) == period, F.avg(value).over(frame))
    h = period // 2
    left = w.rowsBetween(-h, h - 1)
    right = w.rowsBetween(-h + 1, h)
    full = (F.count(value).over(left) == period) & (F.count(value).over(right) == period)
    return F.when(full, (F.avg(value).over(left) + F.avg(value).over(right)) / 2)


def seasonal_decompose(panel: DataFrame, key: str, order_col: str, value: str,
                       period: int) -> DataFrame:
    """Additive decomposition ``value = trend + seasonal + resid``.

    Season of phase ``(row-1) mod period`` = mean of (value - trend) over the
    rows of that phase, minus the mean over phases.  Output
    ``(key, order_col, value, trend, seasonal, resid)``.
    """
    base = _indexed(panel.select(key, order_col, value), key, order_col)
    base = (base.withColumn("trend", centred_trend(value, key, order_col, period))
                .withColumn("_phase", F.pmod(F.col("_t") - 1, F.lit(period))))
    phase = (base.groupBy(key, "_phase")
                 .agg(F.avg(F.col(value) - F.col("trend")).alias("_pm")))
    phase = phase.withColumn("seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy(key)))
    out = base.join(phase.select(key, "_phase", "seasonal"), [key, "_phase"], "left")
    return out.select(key, order_col, value, "trend", "seasonal",
                      (F.col(value) - F.col("trend") - F.col("seasonal")).alias("resid"))


def deseasonalise(panel: DataFrame, key: str, order_col: str, value: str,
                  period: int = 90) -> DataFrame:
    """T4: ``value - seasonal`` with the seasonal part of T1."""
    parts = seasonal_decompose(panel, key, order_col, value, period)
    return parts.select(key, order_col, value, "seasonal",
                        (F.col(value) - F.col("seasonal")).alias("deseasonalised"))


def linear_detrend(panel: DataFrame, key: str, order_col: str, value: str) -> DataFrame:
    """T5: least-squares line on the row index 1..n per key, subtracted.

    Output ``(key, order_col, value, t, slope, intercept, trend_fit, detrended)``.
    """
    base = _indexed(panel.select(key, order_col, value), key, order_col, "t")
    fit = base.groupBy(key).agg(F.regr_slope(F.col(value).cast("double"), F.col("t").cast("double")).alias("slope"),
                                F.regr_intercept(F.col(value).cast("double"), F.col("t").cast("double")).alias("intercept"))
    out = base.join(fit, key)
    trend = F.col("intercept") + F.col("slope") * F.col("t")
    return out.select(key, order_col, value, "t", "slope", "intercept", trend.alias("trend_fit"),
                      (F.col(value) - trend).alias("detrended"))


def periodogram(panel: DataFrame, key: str, order_col: str, value: str,
                samples_per_year: float = 365.0) -> DataFrame:
    """Spectrum of each key's series after removing its least-squares
    line; frequencies in cycles per year.  ``power_k = m |sum y_t
    exp(-2 pi i k t / n)|^2 / n^2`` with m = 2 except k = 0 and k = n/2.

    A key's residuals are one sorted array (a value a day of its history) and
    its sums one fast Fourier transform, n log n whatever n; keys of the same
    length in a batch are transformed together.
    """
    rest = linear_detrend(panel, key, order_col, value).select(key, "t", F.col("detrended").alias("r"))
    arrays = rest.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "r")))["r"].alias("r")).where(F.size("r") > 1)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, size = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy()
            begin = np.cumsum(size) - size
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                power = np.abs(np.fft.rfft(values[begin[own, None] + np.arange(n)], axis=1)) ** 2
                k = np.tile(np.arange(power.shape[1]), len(own))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(own, power.shape[1]))), pa.array(k, pa.int32()),
                     pa.array(np.full(len(k), float(n))), pa.array(power.ravel())], [key, "k", "_n", "_p"])

    kind = arrays.schema[key].dataType.simpleString()
    sums = arrays.mapInArrow(transform, f"`{key}` {kind}, k int, _n double, _p double")
    scale = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("_n")), 1.0).otherwise(2.0)
    return sums.select(key, "k", (samples_per_year * F.col("k") / F.col("_n")).alias("frequency"),
                       (scale * F.col("_p") / (F.col("_n") * F.col("_n"))).alias("power"))


# MacKinnon (2010) response-surface coefficients for the
# Dickey-Fuller tau statistic, constant-only case (one variable):
# (level, tau_inf, c1, c2, c3) with critical value tau_inf + c1/T + c2/T^2 + c3/T^3.
ADF_CRITICAL_CONSTANT = [
    ("1%", -3.43035, -6.5393, -16.786, -79.433),
    ("5%", -2.86154, -2.8903, -4.234, -40.040),
    ("10%", -2.56677, -1.5384, -2.809, 0.0),
]


# MacKinnon (1994) p-value surface of the same statistic: the
# statistic below which the first polynomial holds, its range, and the
# coefficients, in ascending powers, whose value goes through the normal
# distribution.
ADF_P_SPLIT, ADF_P_MIN, ADF_P_MAX = -1.61, -18.83, 2.74
ADF_P_LOW = [2.1659, 1.4412, 0.038269]
ADF_P_HIGH = [1.7339, 0.93202, -0.12745, -0.010368]


def adf_p_value(stat: float) -> float:
    if not np.isfinite(stat):
        return float("nan")
    if stat > ADF_P_MAX or stat < ADF_P_MIN:
        return 1.0 if stat > ADF_P_MAX else 0.0
    powers = ADF_P_LOW if stat <= ADF_P_SPLIT else ADF_P_HIGH
    return normal_cdf(sum(c * stat ** i for i, c in enumerate(powers)))


def default_max_lag(n: int) -> int:
    """Schwert's rule ceil(12 (n/100)^(1/4)), capped so the regression with
    a constant keeps enough observations (n // 2 - 2)."""
    return int(max(0, min(n // 2 - 2, int(np.ceil(12.0 * (n / 100.0) ** 0.25)))))


#: Numbers that one step of the ADF regressions holds at a time.
ADF_STEP = 1 << 22


def _adf_designs(y: np.ndarray, lags: int, level_last: bool) -> np.ndarray:
    """Stacked regressions (series, rows, columns) of series of one length:
    1, y(t-1), dy(t-1) .. dy(t-lags), dy(t), or with y(t-1) behind the lags."""
    dy = np.diff(y, axis=1)
    rows = dy.shape[1] - lags
    before = [dy[:, lags - j:lags - j + rows] for j in range(1, lags + 1)]
    level = [y[:, lags:-1]]
    return np.stack([np.ones((len(y), rows)), *(before + level if level_last else level + before), dy[:, lags:]], 2)


def _adf_blocks(series: list[np.ndarray], lags: np.ndarray, level_last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, designs) of the series of equal length and lags, in steps."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, y in enumerate(series):
        groups.setdefault((len(y), int(lags[i])), []).append(i)
    for (n, p), own in groups.items():
        step = max(1, ADF_STEP // (n * (p + 3)))
        for lo in range(0, len(own), step):
            part = np.array(own[lo:lo + step])
            yield part, _adf_designs(np.stack([series[i] for i in part]), p, level_last)


def _adf_lags(series: list[np.ndarray], caps: np.ndarray) -> np.ndarray:
    """Lag of the least AIC in 0..cap on the rows that all of them have.  One
    elimination holds every lag: its residual after 2 + p columns is p's."""
    used = np.zeros(len(series), np.int64)
    for part, rows in _adf_blocks(series, caps, False):
        rest = eliminate_in_order(rows)[3][:, 1:]
        n, p = rows.shape[1], np.arange(rest.shape[1])
        used[part] = np.argmin(n * np.log(np.where(rest > 0, rest / n, 1e-300)) + 2 * (2 + p), axis=1)
    return used


def _adf_stats(series: list[np.ndarray], lags: np.ndarray) -> np.ndarray:
    """t-value of y(t-1), the last regressor of the elimination."""
    stat = np.full(len(series), np.nan)
    for part, rows in _adf_blocks(series, lags, True):
        live, norm, dot, rest = eliminate_in_order(rows)
        dof = rows.shape[1] - norm.shape[1]
        fits = live.all(axis=1) & (rest[:, -1] > 0) & (dof > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            stat[part] = np.where(fits, dot[:, -1] / np.sqrt(norm[:, -1] * rest[:, -1] / dof), np.nan)
    return stat


def adf_test(panel: DataFrame, key: str, order_col: str, value: str,
             max_lag: int | None = None, autolag: bool = True) -> DataFrame:
    """Augmented Dickey-Fuller regression with a constant per key.

    Regress dy_t on 1, y_{t-1}, dy_{t-1} .. dy_{t-p}; the statistic is the
    t-value of y_{t-1}.  With ``autolag`` p is chosen in 0..max_lag by AIC on
    a common sample (the last n - max_lag - 1 observations), then refit on
    all usable rows.  ``max_lag=None`` applies :func:`default_max_lag` to
    each series' length.  Critical values and the p-value come from the
    published response surfaces.

    A key's series is one sorted array (a value a period of its history).  The
    nested lags are one elimination, a column at a time, and so is the test:
    no system is solved.  Series too short for the lags, or with missing
    values, keep a row of nulls with ``n_obs`` 0; dependent columns or a
    perfect fit give a null statistic.
    """
    y = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    arrays = panel.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("t"), y.alias("y"))))["y"].alias("y"))
    key_type = panel.schema[key].dataType.simpleString()
    crit = [f"crit_{level[:-1]}pct" for level, *_ in ADF_CRITICAL_CONSTANT]
    numbers = ["adf_stat", "p_value", *crit]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, size = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy()
            every = np.split(values, np.cumsum(size)[:-1])
            cap = np.array([default_max_lag(n) if max_lag is None else max_lag for n in size], np.int64)
            fits = np.array([n >= c + 4 and bool(np.isfinite(v).all()) for n, c, v in zip(size, cap, every)], bool)
            series = [v for v, ok in zip(every, fits) if ok]
            lags = _adf_lags(series, cap[fits]) if autolag else cap[fits]
            n = (size[fits] - lags - 1).astype(float)
            stat = _adf_stats(series, lags)
            found = [stat, np.array([adf_p_value(s) for s in stat], float),
                     *(c0 + c1 / n + c2 / n ** 2 + c3 / n ** 3 for _, c0, c1, c2, c3 in ADF_CRITICAL_CONSTANT)]
            place = pa.array(np.where(fits, np.cumsum(fits) - 1, 0), mask=~fits)
            columns = [pa.array(c, from_pandas=True).take(place) for c in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *columns, pa.array(lags, pa.int32()).take(place), pa.array(n, pa.int32()).take(place).fill_null(0)],
                [key, *numbers, "used_lag", "n_obs"])

    schema = ", ".join([f"`{key}` {key_type}", *(f"{c} double" for c in numbers), "used_lag int", "n_obs int"])
    return arrays.mapInArrow(test, schema).select(key, "adf_stat", "p_value", "used_lag", "n_obs", *crit)
