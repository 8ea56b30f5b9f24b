"""Helpers of the operators: rows with an identity, stored intermediates, code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.session import stored  # noqa: F401 - for the operators

# A null id sorts after every other id.
NO_ID = 2**63 - 1
# White space of the contracts: blank and the five control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with null as empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def public_id(column: str) -> Column:
    """The id as it was read: null for rows without one."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per session, and keep batches of long texts small."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if getattr(context, "_cardlake_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    if package.suffix != ".zip" and package.is_dir():
        folder = tempfile.mkdtemp(prefix="cardlake-code-")
        archive = os.path.join(folder, "cardlake_code.zip")
        with zipfile.ZipFile(archive, "w") as files:
            for source in sorted(package.rglob("*.py")):
                files.write(source, source.relative_to(package.parent))
        context.addPyFile(archive)
    context._cardlake_shipped = True
