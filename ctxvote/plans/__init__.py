"""Registered queries, their adapters to the test tables, and their DuckDB statements."""
