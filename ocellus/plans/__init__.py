"""Registered queries: each applies operators to whole tables and carries its DuckDB oracle."""
