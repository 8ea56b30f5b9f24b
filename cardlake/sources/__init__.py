"""Readers: delimited and JSON files, relational tables, date-partitioned Parquet."""
