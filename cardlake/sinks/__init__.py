"""Writers: date-partitioned Parquet, catalog tables, relational tables, CSV exports."""
