"""Indexes of category values: a table of their ranks, and columns with the rank of each value.

Values are ranked by falling frequency, then by text, in a table sorted by range partitions, so no task holds all values
of a column. The table is stored and joined back; no value comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardlake.session import stored


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of every value, as text, of every column; missing values are left out. ``df`` is read once."""
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).cast("string").alias("value")) for name in columns))
    rows = df.select(F.explode(pairs).alias("pair")).select("pair.*").where("value IS NOT NULL")
    return rows.groupBy("name", "value").agg(F.count("*").alias("n_rows"))


def category_index(df: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """name, value, n_rows and idx, from 0 for the most frequent value of a column.

    ``most`` keeps so many values of a column; the others fold into one index behind them, that of unseen and missing
    values.
    """
    order = [F.col("name"), F.desc("n_rows"), F.col("value")]
    ranged = value_counts(df, columns).repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits count the rows of a part. Stored, as parts and places must not change between two reads.
    placed = stored(
        ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place")),
        "ranked",
    )
    # One row for each column and part.
    parts = placed.groupBy("name", "part").agg(F.count("*").alias("values"), F.min("place").alias("first"))
    before = F.sum("values").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("name", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    ranked = placed.join(F.broadcast(starts), ["name", "part"]).withColumn("idx", (F.col("place") + F.col("shift")).cast("double"))
    kept = ranked if most is None else ranked.where(F.col("idx") < most)
    return kept.select("name", "value", "n_rows", "idx")


def index_sizes(index: DataFrame) -> dict[str, int]:
    """Values of each column in the index: one number a column."""
    return {row["name"]: row["n"] for row in index.groupBy("name").agg(F.count("*").alias("n")).collect()}


def with_indexes(df: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_idx``. Values that the index does not have, and missing ones, get the next free index."""
    sizes = index_sizes(index)
    for name in columns:
        own = index.where(F.col("name") == name).select(F.col("value").alias("_value"), F.col("idx").alias("_idx"))
        joined = df.join(own, F.col(name).cast("string") == F.col("_value"), "left")
        df = joined.withColumn(f"{name}_idx", F.coalesce("_idx", F.lit(float(sizes.get(name, 0))))).drop("_value", "_idx")
    return df
