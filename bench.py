"""Benchmark the headline queries.

Runs each query of HEADLINE at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Every query is executed in full with the no-op sink (all rows computed,
nothing collected to the driver).  One warm-up run of the flagship on sf0.001 absorbs
JVM start-up; each headline query is timed once.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "co_purchase_report",       # flagship: basket self-join, top/bottom partners
    "co_purchase_by_article",   # same at the finest grain (most pairs)
    "co_purchase_detail",       # lift + partner metadata
    "pair_lift",
    "prepared_rows",
    "sales_share",
    "daily_product_sales",
    "extended_features",
    "horizon_table",
    "forecast_rollup_day",
    "seasonal_parts",
    "periodogram",
    "sensitivity_price",
    "own_cross_price",
    "count_histogram",
    "table_summary",
    "wide_actual_prediction",
    "adf_search",
    "rf_forecast",
    "score_all",
    "gbt_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from tillroll.session import get_spark, checkpoint_dir
    spark = get_spark(f"local[{cpus}]", int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2)),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="tillroll-bench-"))
    from tillroll.plans.catalog import queries
    qs = queries()
    # Warm-up on the smallest tables: JIT-compiles the code paths without
    # touching the data being timed (skipped when they are not there).
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if Path(warm, "lineitem.parquet").exists():
        qs["co_purchase_report"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
