"""Date parts as partition columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.functions.casts import to_day


def with_day_parts(df: DataFrame, source: str = "situation_date") -> DataFrame:
    """Type ``source`` as a date and add year, month and day of it."""
    typed = df.withColumn(source, to_day(source))
    return typed.withColumns({"year": F.year(source), "month": F.month(source), "day": F.dayofmonth(source)})


def padded_day_literals(day: date) -> dict[str, Column]:
    """Zero-padded text, so that the folders read ``month=05/day=09``."""
    return {
        "year": F.lit(f"{day:%Y}"),
        "month": F.lit(f"{day:%m}"),
        "day": F.lit(f"{day:%d}"),
    }


def path_day_parts(path: Column) -> dict[str, Column]:
    """Year, month and day found in a ``year=Y/month=M/day=D`` path; null where the path has none."""
    return {
        part: F.regexp_extract(path, r"year=(\d{4})/month=(\d{1,2})/day=(\d{1,2})", group).try_cast("int")
        for group, part in enumerate(("year", "month", "day"), start=1)
    }
