"""Date-partitioned Parquet. Writing the same days again replaces them, so a rerun adds nothing."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cardlake.functions.dates import padded_day_literals, with_day_parts
from cardlake.schemas import DAY_PARTS


# Files that a task of a write by days keeps open; only with more days in it, it sorts the rest of its rows by day.
OPEN_FILES = 2
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def without_sort(spark: SparkSession):
    """Writes by days in here do not sort their rows by day first, as a task has one day or few."""
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.set(_WRITERS, before)


def _write(df: DataFrame, root: str, mode: str) -> None:
    # Dynamic: only the days present in the frame are replaced.
    with without_sort(df.sparkSession):
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*DAY_PARTS).parquet(root)


def write_by_situation_date(df: DataFrame, root: str, mode: str = "overwrite", rebalance: bool = True) -> dict[str, int]:
    """Write rows into the day of their ``situation_date``; returns the rows written and those without a date.

    ``overwrite`` replaces whole days and so needs all id ranges of a day in one frame; use ``append``
    to load ranges one by one. Rows without a readable date stay in the null partition and are counted.
    ``rebalance`` lets the runtime size the files per day and split a day that holds most of the rows.
    """
    seen = Observation("bronze")
    dated = with_day_parts(df).observe(
        seen,
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("situation_date").isNull()).alias("n_undated"),
    )
    _write(dated.hint("rebalance", *DAY_PARTS) if rebalance else dated, root, mode)
    return seen.get


def write_ingestion_day(df: DataFrame, root: str, day: date) -> int:
    """Write a whole dataset as the snapshot of one ingestion day; returns its number of rows."""
    seen = Observation("snapshot")
    _write(df.observe(seen, F.count(F.lit(1)).alias("n_rows")).withColumns(padded_day_literals(day)), root, "overwrite")
    return seen.get["n_rows"]
