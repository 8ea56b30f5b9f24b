"""Counts and checks on the layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.functions.casts import to_day


def layer_counts(layers: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Rows per (layer, entity); empty ones included."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(layer).alias("layer"), F.lit(entity).alias("entity"), "n_rows")
        for (layer, entity), df in layers.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def label_conflicts(labels: DataFrame) -> DataFrame:
    """Ids with more than one label; each would appear once per label in the label join."""
    per_label = labels.groupBy("id", "label").agg(F.count("*").alias("n"))
    per_id = per_label.groupBy("id").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_labels"), F.min("label").alias("first_label")
    )
    return per_id.where("n_labels > 1")


def duplicate_codes(mcc_codes: DataFrame) -> DataFrame:
    """Category codes listed more than once."""
    return mcc_codes.groupBy("mcc_code").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def undated(df: DataFrame, day: str = "situation_date") -> DataFrame:
    """Rows whose date is missing or unreadable."""
    return df.where(to_day(day).isNull())
