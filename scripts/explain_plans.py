"""Summarise the executed (adaptive, final) physical plans of the headline
queries into PLANS.md: operator counts and the parquet scans' read schema
and pushed filters.

Usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import io
import re
import sys
from collections import Counter
from contextlib import redirect_stdout
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

OPS = ["Exchange", "ReusedExchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
       "BroadcastNestedLoopJoin", "ShuffledHashJoin", "WindowGroupLimit", "Window", "HashAggregate",
       "ObjectHashAggregate", "Generate", "FlatMapGroupsInPandas", "MapInArrow", "Scan parquet", "Scan ExistingRDD"]


def summarise(plan: str) -> tuple[Counter, list[str]]:
    body = plan.split("\n\n(")[0]
    if "== Initial Plan ==" in body:  # adaptive plans print both; count the final one
        body = body.split("== Initial Plan ==")[0]
    counts = Counter()
    for line in body.splitlines():
        m = re.search(r"[+:-]+\s*\*?\s*([A-Za-z ]+?) \(\d+\)", line)
        if m:
            name = m.group(1).strip()
            for op in OPS:
                if name == op:
                    counts[op] += 1
    scans = []
    for block in plan.split("\n\n"):
        if block.startswith("(") and "Scan parquet" in block.splitlines()[0]:
            loc = re.search(r"Location: .*?\[(.*?)\]", block)
            table = Path(loc.group(1).split(",")[0]).name if loc else "?"
            rs = re.search(r"ReadSchema: (.*)", block)
            pf = re.search(r"PushedFilters: (.*)", block)
            scans.append(f"`{table}` read {rs.group(1) if rs else '?'}; pushed {pf.group(1) if pf else '[]'}")
    return counts, scans


def main() -> None:
    from tillroll.session import get_spark
    from tillroll.plans.catalog import queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = ["co_purchase_report", "co_purchase_detail_item", "pair_lift", "sales_share",
             "daily_product_sales", "extended_features", "horizon_table", "forecast_rollup_day",
             "seasonal_parts", "periodogram", "adf_search", "own_cross_price", "distinct_counts"]
    # The provided tables fit a broadcast, the real ones would not.
    spark = get_spark("local[8]", 8, extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    qs = queries()
    out = ["# Executed plans of the headline queries", "",
           f"Generated by `scripts/explain_plans.py` at `{sf_dir}` (final adaptive plans after one run, `autoBroadcastJoinThreshold` -1).", ""]
    for name in names:
        df = qs[name](spark, sf_dir)
        df._jdf.queryExecution().toRdd().count()  # runs this plan without moving rows to Python
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        counts, scans = summarise(buf.getvalue())
        out.append(f"## {name}")
        out.append("")
        out.append(", ".join(f"{k}: {v}" for k, v in counts.items() if v))
        out.append("")
        for s in sorted(set(scans)):
            out.append(f"* {s}")
        out.append("")
    (ROOT / "PLANS.md").write_text("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
