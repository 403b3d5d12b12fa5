"""Registry of named queries.

Each query is a function ``(spark, sf_dir) -> DataFrame`` that reads the
provided tables (through :func:`tillroll.sources.load_retail_tables`) and
runs one operator of the package.  Next to it sits the DuckDB SQL that
computes the same result on the same parquet files (``None`` for operators
that SQL cannot express, which get a row-count check only).

Output conventions shared by both sides: doubles go through
DECIMAL(38,10) and are rounded to 6 places, arrays are joined with ``|``,
counts are BIGINT, days are DATE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_TABLE_CACHE: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def tables(spark: SparkSession, sf_dir: str):
    """Lazy retail views of ``sf_dir`` (cached per live session: a stopped
    and re-created session never sees frames of the old one)."""
    from tillroll.sources.testdata import load_retail_tables
    hit = _TABLE_CACHE.get(sf_dir)
    if hit is None or hit[0] is not spark or hit[1].transactions.sparkSession is not spark:
        hit = (spark, load_retail_tables(spark, sf_dir))
        _TABLE_CACHE[sf_dir] = hit
    return hit[1]


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Normalise a result for comparison: round doubles, join string arrays."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # Through decimal(38,10) first: values that differ only in the
            # last bits (summation order) collapse before the 6-place round.
            # Values that the decimal cannot hold (huge, infinite, NaN) stay.
            rounded = F.round(c.try_cast("decimal(38,10)"), digits).cast("double")
            c = F.when(F.abs(c) < 1e27, rounded).otherwise(c.cast("double"))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws("|", F.transform(c, lambda x: x.cast("string")))
        cols.append(c.alias(f.name))
    return df.select(cols)
