"""Sources and sinks: schemas, readers, writers, and the test-data mapping."""

from tillroll.sources.schemas import (TRANSACTIONS, ARTICLES, TRANSACTION_GRID,
                                      HOLIDAYS, require_columns)
from tillroll.sources.io import (read_table, write_table, read_csv_table,
                                 write_csv_table, write_partitioned)
from tillroll.sources.testdata import RetailTables, load_retail_tables

__all__ = ["TRANSACTIONS", "ARTICLES", "TRANSACTION_GRID", "HOLIDAYS",
           "require_columns", "read_table", "write_table", "read_csv_table",
           "write_csv_table", "write_partitioned", "RetailTables",
           "load_retail_tables"]
