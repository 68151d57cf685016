"""Queries over the parquet tables, and their SQL."""
