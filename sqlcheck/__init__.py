"""DuckDB oracle SQL for the registered queries (the correctness gate)."""
