"""Oracle SQL (DuckDB), comparison and plan-report tools."""
