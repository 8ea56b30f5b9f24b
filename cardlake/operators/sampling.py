"""Balanced sampling and splitting on hash buckets of a key, in one pass and with no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.functions.hashing import hash_bucket


def class_balance(labelled: DataFrame) -> DataFrame:
    """Rows per class, counted in one pass."""
    return labelled.groupBy("fraud_label").agg(F.count("*").alias("n_rows"))


def balanced_sample(labelled: DataFrame, key: str = "id", keep_one_in: int = 10, seed: int = 42) -> DataFrame:
    """All frauds and every tenth (by hash of the key) of the rest; rows without a class are left out."""
    is_kept = hash_bucket(key, keep_one_in, f"sample-{seed}") == 0
    return labelled.where((F.col("fraud_label") == 1) | ((F.col("fraud_label") == 0) & is_kept))


def with_split(df: DataFrame, key: str = "id", train_percent: int = 80, seed: int = 42) -> DataFrame:
    """Add ``split``, train or test; all rows of one key fall in the same part."""
    in_train = hash_bucket(key, 100, f"split-{seed}") < train_percent
    return df.withColumn("split", F.when(in_train, "train").otherwise("test"))


def train_test_split(
    df: DataFrame, key: str = "id", train_percent: int = 80, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    split = with_split(df, key, train_percent, seed)
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
