"""Queries over the test tables, each with SQL that DuckDB can run where SQL can express it."""
