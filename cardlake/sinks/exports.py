"""CSV exports of query results."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, folder: str, now: datetime | None = None) -> str:
    """Write ``df`` into a new time-stamped folder of CSV parts, each with a header line; returns its path.

    Quotes inside values are doubled, as spreadsheets and other CSV readers expect. The name ends with a
    random part, so that exports of one second do not meet.
    """
    path = f"{folder.rstrip('/')}/query_{now or datetime.now():%Y-%m-%d_%H-%M-%S}_{uuid.uuid4().hex[:8]}"
    writer = df.write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path
