"""Session helpers.

The settings below are the ones every operator in this package relies on:
adaptive execution (runtime coalescing, skew-join splitting and
broadcast conversion behind Spark's own size statistics), UTC session time
and Arrow transfer for the few grouped pandas functions.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tillroll", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` and ``shuffle_partitions`` are only set when given, so on a
    cluster the submit-time settings win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: its modules go as one archive
    into the shared folder and from there to the executors, once a
    session.  Nothing is sent if ``PYTHONPATH`` already names the package's
    folder, which workers then have too."""
    package = Path(__file__).resolve().parent
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for module in sorted(package.rglob("*.py")):
            z.write(module, module.relative_to(package.parent))
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, package.name) + ".zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(archive.getvalue())
    finally:
        out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator of the cluster and
    is only read here (an unset folder is an error there).  In local mode,
    when it is unset (tests), a fresh folder is made under ``fallback`` or
    the system temporary directory and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) session: the server owns the folder
        return current
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) "
                           "that every executor can reach")
    base = fallback or tempfile.gettempdir()
    path = tempfile.mkdtemp(prefix="tillroll-ckpt-", dir=base)
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    root = checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str = "table"):
    """Write ``df`` as Parquet to the shared folder and read it back: one
    computation for several readers, with column pruning, filter push-down
    and size statistics, and nothing to recompute when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def removed_after(df, name: str = "table"):
    """:func:`materialise` for the passes inside; the table is deleted then."""
    path = scratch_path(df.sparkSession, name)
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        jvm.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm, True)
