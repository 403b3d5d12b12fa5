"""Every registered query against its DuckDB oracle at sf0.001 (the driver
runs the same comparison at sf0.01)."""

import pytest

from tillroll.plans.catalog import oracle_sql, queries
from tillroll.plans.oracle_check import compare, duck

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: No day of the small tables has all prices, which leaves these empty there.
LARGER = {"own_cross_price", "log_price_model", "cross_price_complete"}
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def connections():
    return {sf: duck(sf) for sf in (SMALL, MID)}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, connections, name):
    sf = MID if name in LARGER else SMALL
    msg, ok = compare(spark, connections[sf], name, queries()[name], oracle_sql().get(name), sf)
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
