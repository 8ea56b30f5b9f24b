"""Bronze: sources to date-partitioned Parquet."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from cardlake.functions.casts import to_day
from cardlake.sinks.days import write_by_situation_date, write_ingestion_day
from cardlake.sinks.loads import EVERY_ID, load_window, record_whole_days
from cardlake.sources.files import read_csv, read_json
from cardlake.sources.relational import DEFAULT_SIZE, id_ranges, jdbc_rows_outside, read_jdbc_ranges


def ingest_transactions(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    bronze_root: str,
    table: str = "transactions",
    window: tuple[int, int] | None = None,
    size: int = DEFAULT_SIZE,
    count: int | None = None,
    everything: bool = False,
    mode: str = "overwrite",
) -> dict[str, int]:
    """Copy a relational table in id ranges; the rows of the source are read once.

    All ids are read, unless a window of ids is given without ``everything``. Such a window needs
    ``append``, as replacing a day would delete what other windows have loaded for it; the rows
    outside it are counted as ``n_outside``. ``append`` leaves out, as ``n_held``, the ids that are loaded for their
    day already, so a window can be run again; ``overwrite`` replaces whole days, whatever is loaded.
    """
    ranges = id_ranges(*window, size, count) if window else None
    partial = window is not None and not everything
    if partial and mode == "overwrite":
        raise ValueError("a window of ids can't replace whole days; use append, or read everything")
    rows = read_jdbc_ranges(spark, url, table, properties, ranges, size=size, count=count, everything=everything)
    outside = jdbc_rows_outside(spark, url, table, properties, ranges) if partial else 0
    root = f"{bronze_root}/transactions"
    if mode == "append":
        return {**load_window(rows, root, (ranges[0][0], ranges[-1][1] - 1) if partial else EVERY_ID), "n_outside": outside}
    seen = Observation("days")
    text = rows.withColumn("situation_date", F.col("situation_date").cast("string"))
    # One value a day; a null, which the set leaves out, is counted.
    days = text.observe(seen, F.collect_set(to_day("situation_date")).alias("days"), F.count_if(to_day("situation_date").isNull()).alias("undated"))
    counts = write_by_situation_date(days, root, mode)
    record_whole_days(spark, root, [*seen.get["days"], *([None] if seen.get["undated"] else [])])
    return {**counts, "n_outside": outside, "n_held": 0}


def ingest_csv(spark: SparkSession, name: str, path: str, bronze_root: str, day: date) -> int:
    return write_ingestion_day(read_csv(spark, path), f"{bronze_root}/{name}", day)


def ingest_json(spark: SparkSession, name: str, path: str, bronze_root: str, day: date, **options) -> int:
    return write_ingestion_day(read_json(spark, name, path, **options), f"{bronze_root}/{name}", day)
