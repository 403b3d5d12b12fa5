"""Shared helpers: bounded slices of Arrow text columns, written tables in the
shared scratch folder and the registry of this package's queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bytes of text that one vectorised step holds at a time inside a task.
SLICE_BYTES = 1 << 20


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Jobs in this block drop their shuffle files as soon as they end; what
    they wrote is read from the shared folder from then on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_OPEN: list[list] = []


@contextmanager
def scratch_tables():
    """Tables that :func:`written` and :func:`distinct_texts` make in this block
    are deleted at its end, but for those handed to the function it yields."""
    made: list = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.scratch)
        return table

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.remove(made)
        for t in made:
            if t.scratch not in kept:
                discard(t)
            elif _OPEN:
                _OPEN[-1].append(t)  # the block around this one decides


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later
    reads survive lost executors and prune columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_files_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        if getattr(t, "named", None):
            spark.sql(f"DROP TABLE IF EXISTS {t.named}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text that a bucket of distinct_texts takes about.
BUCKET_BYTES = 256 << 20


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """tid (64-bit hash), text and whether it has copies, of every distinct text
    (nulls left out); kept in buckets of tid, so that joins on it move no
    text.  Copies are combined before the shuffle.  There are as many buckets
    as shuffle partitions, more if the texts are too large for that.  Only a
    table with a name can have buckets; :func:`discard` drops the name."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    grouped = docs.where(text.isNotNull()).groupBy(F.xxhash64(text).alias("tid")).agg(
        F.collect_set(text).alias("texts"), F.count(F.lit(1)).alias("n"))
    rows = grouped.select("tid", F.explode("texts").alias("text"), (F.col("n") > F.size("texts")).alias("copied"))
    path = scratch_path(spark, "texts")
    name = "texts_" + path.rsplit("-", 1)[1]
    with shuffle_files_removed(spark):
        rows.write.option("path", path).option("compression", "zstd").bucketBy(min(buckets, 100_000), "tid").saveAsTable(name)
    out = spark.table(name)
    out.scratch, out.named = path, name
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable."""
    return F.transform(F.array(value), fn)[0]


def crc_mod(col: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> pa.Array:
    """A text column as binary with 64-bit offsets, null as empty."""
    a = column.cast(pa.large_binary())
    return a.fill_null(b"") if a.null_count else a


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a large_binary column holding at most ``limit`` bytes
    each (a longer single row stands alone)."""
    import numpy as np
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi
        lo = hi


def joined_bytes(column: pa.Array, lo: int, hi: int):
    """Bytes of rows ``lo`` to ``hi`` as one array, and the row offsets in it."""
    import numpy as np
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset + lo:column.offset + hi + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]
