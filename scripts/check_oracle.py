"""Run registered queries in Spark and their SQL in DuckDB; compare.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillroll.plans.oracle_check import compare, duck  # noqa: E402


def main():
    from tillroll.session import get_spark
    from tillroll.plans.catalog import queries, oracle_sql
    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a]
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs, oracles = queries(), oracle_sql()
    ok = 0
    total = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        total += 1
        try:
            msg, good = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and continue
            msg, good = f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}", False
        ok += good
        print(msg, flush=True)
    print(f"SUMMARY {ok}/{total} ok")


if __name__ == "__main__":
    main()
