"""Registered queries, each with its DuckDB counterpart where SQL can express it."""
