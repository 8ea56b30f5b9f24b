"""Snapshots of a table as versioned folders below its path.

A version is whole once its folder has the marker that Spark writes last; the newest such version is the table's content
for readers of files. Versions that were never finished are not read, and the next one that is written removes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX, _MARKER = "version-", "_SUCCESS"
# Readers of the one before the newest may still be at work.
KEPT = 2


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """Number, folder and wholeness of every version, oldest first. The cost grows with versions, not with files."""
    fs, pattern = _fs(spark, f"{path.rstrip('/')}/{_PREFIX}*")
    found = []
    for status in fs.globStatus(pattern) or []:
        number = status.getPath().getName()[len(_PREFIX) :].split("-")[0]
        if status.isDirectory() and number.isdigit():
            folder = status.getPath().toString()
            found.append((int(number), folder, fs.exists(_fs(spark, f"{folder}/{_MARKER}")[1])))
    return sorted(found)


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of the newest whole version; ``path`` itself where there are none, as for a plain folder of files."""
    whole = [folder for _, folder, is_whole in versions(spark, path) if is_whole]
    return whole[-1] if whole else path


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current_path(spark, path))


def new_version(spark: SparkSession, path: str) -> str:
    """A folder for the next version; it does not exist yet."""
    number = max((number for number, _, _ in versions(spark, path)), default=0) + 1
    return f"{path.rstrip('/')}/{_PREFIX}{number:08d}-{uuid.uuid4().hex[:8]}"


def remove_old(spark: SparkSession, path: str, kept: int = KEPT) -> None:
    """Delete versions that were never finished, and whole ones before the newest ``kept``."""
    known = versions(spark, path)
    whole = [folder for _, folder, is_whole in known if is_whole]
    newest = whole[-kept:]
    for _, folder, _ in known:
        if folder not in newest:
            _fs(spark, folder)[0].delete(_fs(spark, folder)[1], True)
