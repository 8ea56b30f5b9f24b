"""Silver: newest Bronze day to typed, deduplicated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cardlake.operators.cleaning import CLEANERS
from cardlake.schemas import DAY_PARTS
from cardlake.sinks.tables import replace_days, write_table
from cardlake.sources.days import read_days


def build_entity(spark: SparkSession, bronze_root: str, entity: str, mode: str = "latest") -> DataFrame:
    """Cleaned rows of an entity; a missing Bronze dataset raises."""
    return CLEANERS[entity](read_days(spark, f"{bronze_root}/{entity}", mode))


def refresh_entity(
    spark: SparkSession,
    bronze_root: str,
    silver_root: str,
    entity: str,
    mode: str = "latest",
    keep_other_days: bool = False,
    database: str = "silver",
    bucket_by: tuple[str, int] | None = None,
) -> int:
    """Write ``silver.<entity>`` and return its number of rows, counted while they are written."""
    seen = Observation(entity)
    cleaned = build_entity(spark, bronze_root, entity, mode).observe(seen, F.count(F.lit(1)).alias("n_rows"))
    if mode == "all":
        # Deduplication leaves every day in every task; gather the days again, else each task writes each day.
        cleaned = cleaned.hint("rebalance", *DAY_PARTS)
    table, path = f"{database}.{entity}", f"{silver_root}/{entity}"
    if keep_other_days:
        replace_days(cleaned, table, path)
    else:
        write_table(cleaned, table, path, bucket_by=bucket_by)
    return seen.get["n_rows"]


def refresh_silver(
    spark: SparkSession,
    bronze_root: str,
    silver_root: str,
    mode: str = "latest",
    keep_other_days: bool = False,
    database: str = "silver",
) -> dict[str, int]:
    """Refresh every entity; the first failure stops the job."""
    return {
        entity: refresh_entity(spark, bronze_root, silver_root, entity, mode, keep_other_days, database)
        for entity in CLEANERS
    }
