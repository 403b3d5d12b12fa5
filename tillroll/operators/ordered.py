"""Exact running sums over a global order without a single-task window.

A window with ``orderBy`` and no ``partitionBy`` runs in one task.  Here
the rows are range partitioned on (value, tie), written once, each range gets
its own running sum in parallel, and the totals of the earlier ranges (one row
per partition) are added back.  The tie column is part of the range, so any
number of equal values is cut into as many tasks as their rows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import materialise


def one_row(df: DataFrame) -> DataFrame:
    """A global aggregate (no grouping keys, so exactly one row) attached to
    every row of another frame by ``crossJoin``: a scalar, broadcast with a
    size bound of one row, never a product of two data-sized tables."""
    return F.broadcast(df)


def running_sum_desc(df: DataFrame, value: str, tie: str, out: str, summed: str | None = None) -> DataFrame:
    """``out`` = sum of ``summed`` (default ``value``) over all rows ordered
    before or at this row in the order ``value`` descending, ``tie``
    ascending.  With a column of ones it is the 1-based position."""
    summed = summed or value
    order = [F.col(value).desc(), F.col(tie).asc()]
    ranged = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_part").agg(F.sum(summed).alias("_sum"))
    # One row per partition of the shuffle above.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(totals.schema["_sum"].dataType)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), zero).alias("_offset"))
    return (ranged.withColumn("_within", F.sum(summed).over(within))
                  .join(F.broadcast(offsets), "_part")
                  .withColumn(out, F.col("_offset") + F.col("_within"))
                  .drop("_part", "_within", "_offset"))
