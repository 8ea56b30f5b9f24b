"""Date-partitioned Parquet: finding and reading the newest day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.functions.dates import path_day_parts
from cardlake.schemas import DAY_PARTS


def list_days(spark: SparkSession, root: str) -> dict[tuple[int, int, int], list[str]]:
    """Folders per (year, month, day) under ``root``, on any Hadoop file system.

    Only folder names are listed, so the cost grows with the number of days and not with the
    number of files. Plain files, other names and null partitions are passed over.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/year=*/month=*/day=*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    days: dict[tuple[int, int, int], list[str]] = {}
    for status in fs.globStatus(pattern) or []:
        path = status.getPath()
        names = [path.getParent().getParent().getName(), path.getParent().getName(), path.getName()]
        values = [name.split("=", 1)[1] for name in names]
        if status.isDirectory() and all(value.isdigit() for value in values):
            days.setdefault(tuple(map(int, values)), []).append(path.toString())
    return days


def newest_day(spark: SparkSession, root: str) -> tuple[int, int, int] | None:
    """The latest (year, month, day) by number, or None when there is no such folder."""
    return max(list_days(spark, root), default=None)


def read_days(spark: SparkSession, root: str, mode: str = "latest") -> DataFrame:
    """Rows of the newest day (``latest``) or of every day (``all``), with their partition columns.

    For the newest day only its own folder is listed and read.
    """
    days = list_days(spark, root)
    if not days:
        raise FileNotFoundError(f"no year=/month=/day= folder below {root}")
    if mode == "all":
        return spark.read.parquet(root)
    if mode != "latest":
        raise ValueError(f"mode must be 'latest' or 'all', not {mode!r}")
    return spark.read.option("basePath", root).parquet(*days[max(days)])


def latest_rows(df: DataFrame) -> DataFrame:
    """Rows of a table's newest day; finding it reads the partition columns only."""
    year, month, day = map(F.col, DAY_PARTS)
    number = year * 10_000 + month * 100 + day
    return df.where(number == df.agg(F.max(number)).scalar())


def with_path_days(df: DataFrame) -> DataFrame:
    """Add year, month and day taken from each row's file path; for reads that do not discover partitions."""
    return df.withColumns(path_day_parts(F.col("_metadata.file_path")))
