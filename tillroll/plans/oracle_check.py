"""Compare registered queries with their DuckDB oracle SQL.

The SQL is stored as a view first, so that statements a view cannot hold
(a pivot whose columns depend on the data) are found here.  Row count, column
names (sorted) and order-insensitive values are compared after normalisation
(floats to 6 places, dates as ISO text, missing values as None).  A query
without SQL must at least return rows.
"""

from __future__ import annotations

import math
import time
from pathlib import Path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    import datetime
    import decimal
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, datetime.datetime):
        if v.hour == 0 and v.minute == 0 and v.second == 0:
            return v.date().isoformat()
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(v) for v in rec))
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return f"{name}: rows-only spark_rows={len(spdf)} ({t1 - t0:.1f}s)", len(spdf) > 0
    con.execute(f"CREATE OR REPLACE VIEW oracle_of_query AS {sql}")
    dpdf = con.execute("SELECT * FROM oracle_of_query").df()
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    if sc != dc:
        return f"{name}: COLUMNS differ spark={sc} duck={dc}", False
    if len(sr) != len(dr):
        return f"{name}: ROWCOUNT spark={len(sr)} duck={len(dr)}", False
    if not dr:
        return f"{name}: EMPTY on both sides, nothing is compared", False
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{name}: VALUES differ in {len(bad)} rows, e.g. spark={bad[0][0]} duck={bad[0][1]}", False
    return f"{name}: OK rows={len(sr)} ({t1 - t0:.1f}s)", True


