"""Calendar dimension: a holiday table built by rule.

The holiday dimension replaces a rule library with a table that Spark derives
from the years present in the data.  Easter Sunday is computed with the
anonymous Gregorian algorithm; the movable feasts are offsets from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# National public holidays of Germany.
# Fixed-date holidays as (month, day, name).
FIXED_HOLIDAYS = [
    (1, 1, "New Year's Day"),
    (5, 1, "Labour Day"),
    (10, 3, "German Unity Day"),
    (12, 25, "Christmas Day"),
    (12, 26, "Second Day of Christmas"),
]
# One-off holidays as (year, month, day, name).
SINGLE_HOLIDAYS = [
    (2017, 10, 31, "Reformation Day"),
]
# Movable holidays as (days after Easter Sunday, name).
EASTER_OFFSETS = [
    (-2, "Good Friday"),
    (1, "Easter Monday"),
    (39, "Ascension Day"),
    (50, "Whit Monday"),
]


def easter_sunday(year_col) -> F.Column:
    y = year_col
    a = F.pmod(y, F.lit(19))
    b = F.floor(y / 100)
    c = F.pmod(y, F.lit(100))
    d = F.floor(b / 4)
    e = F.pmod(b, F.lit(4))
    f = F.floor((b + 8) / 25)
    g = F.floor((b - f + 1) / 3)
    h = F.pmod(19 * a + b - d - g + 15, F.lit(30))
    i = F.floor(c / 4)
    k = F.pmod(c, F.lit(4))
    l_ = F.pmod(32 + 2 * e + 2 * i - h - k, F.lit(7))
    m = F.floor((a + 11 * h + 22 * l_) / 451)
    n = h + l_ - 7 * m + 114
    return F.make_date(y.cast("int"), F.floor(n / 31).cast("int"), (F.pmod(n, F.lit(31)) + 1).cast("int"))


def holiday_table(dates: DataFrame, date_col: str = "d") -> DataFrame:
    """Holidays for every year between the first and last date of ``dates``.

    The year range is a one-row aggregate; the table holds 9 rows per year
    and the one-off days.
    """
    years = (dates.agg(F.min(F.year(date_col)).alias("y0"), F.max(F.year(date_col)).alias("y1"))
                  .where(F.col("y0").isNotNull())
                  .select(F.explode(F.sequence("y0", "y1")).alias("year")))
    fixed = F.array(*[F.struct(F.make_date(F.col("year"), F.lit(m), F.lit(d)).alias("holiday_date"),
                               F.lit(name).alias("holiday_name"))
                      for m, d, name in FIXED_HOLIDAYS])
    easter = easter_sunday(F.col("year"))
    movable = F.array(*[F.struct(F.date_add(easter, off).alias("holiday_date"),
                                 F.lit(name).alias("holiday_name"))
                        for off, name in EASTER_OFFSETS])
    single = F.filter(F.array(*[F.struct(F.lit(f"{y}-{m:02}-{d:02}").cast("date").alias("holiday_date"),
                                         F.lit(name).alias("holiday_name")) for y, m, d, name in SINGLE_HOLIDAYS]),
                      lambda h: F.year(h["holiday_date"]) == F.col("year"))
    return (years.select(F.explode(F.concat(fixed, movable, single)).alias("h"))
                 .select("h.holiday_date", "h.holiday_name"))


def with_holiday_flag(df: DataFrame, date_col: str, holidays: DataFrame,
                      out: str = "holiday_flag") -> DataFrame:
    """Left join to the holiday dimension; 1 when the day is a holiday.

    The dimension holds a fixed number of rows per calendar year (so its
    size is bounded by the date range, not by the data) and is broadcast.
    """
    days = holidays.select(F.col("holiday_date").alias("_hd")).distinct()
    return (df.join(F.broadcast(days), F.col(date_col) == F.col("_hd"), "left")
              .withColumn(out, F.col("_hd").isNotNull().cast("int"))
              .drop("_hd"))
