"""Named query plans (the registered query set) and their DuckDB oracles."""
