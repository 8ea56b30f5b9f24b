"""Joins between the entities.

No side is hinted for broadcast: the optimizer and AQE broadcast a side whose size they have
checked against the threshold, and AQE splits the partitions of a hot key otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.functions.casts import fraud_flag

FRAUD_VALUES = ("Yes", "1")


def label_transactions(
    transactions: DataFrame, labels: DataFrame, fraud_values: tuple[str, ...] = FRAUD_VALUES
) -> DataFrame:
    """Every transaction with its label and ``is_fraud``; one row per label where an id has several."""
    joined = transactions.join(labels.select("id", "label"), "id", "left")
    return joined.withColumn("is_fraud", fraud_flag("label", fraud_values))


def keep_labelled(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions whose id has a label, each once."""
    return transactions.join(labels.select("id"), "id", "left_semi")


def clients_with_cards(users: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per card, with the card's owner."""
    owners = users.select(F.col("id").alias("user_id"), "gender", "num_credit_cards")
    owned = cards.select("client_id", "credit_limit_usd")
    return owners.join(owned, F.col("user_id") == F.col("client_id")).select(
        "user_id", "gender", "credit_limit_usd", "num_credit_cards"
    )


def describe_categories(df: DataFrame, mcc_codes: DataFrame) -> DataFrame:
    """Add the category description of ``mcc``; null for unknown codes."""
    codes = mcc_codes.select("mcc_code", "description")
    return df.join(codes, F.col("mcc") == F.col("mcc_code"), "left")


def flag_labels(labels: DataFrame, fraud_values: tuple[str, ...] = FRAUD_VALUES) -> DataFrame:
    """Labelled ids with ``fraud_label``, 1 or 0."""
    return labels.select("id", fraud_flag("label", fraud_values).alias("fraud_label"))


def labelled_base(transactions: DataFrame, flagged: DataFrame) -> DataFrame:
    """Labelled transactions with ``fraud_label``.

    Keeping the labelled ids and then joining the labels is one inner join, so the fact is shuffled once.
    """
    return transactions.join(flagged, "id")


def add_card_features(df: DataFrame, cards: DataFrame) -> DataFrame:
    """Add brand, type, chip (as 0/1) and credit limit of the card; nulls for an unknown card."""
    features = cards.select(
        F.col("id").alias("card_id"),
        "card_brand",
        "card_type",
        F.col("has_chip").cast("int").alias("has_chip"),
        "credit_limit_usd",
    )
    return df.join(features, "card_id", "left")


def feature_base(
    transactions: DataFrame, flagged: DataFrame, cards: DataFrame, mcc_codes: DataFrame
) -> DataFrame:
    """Labelled transactions with the features of their card and category.

    Give it a sample of the flagged labels to join only the sampled transactions.
    """
    base = labelled_base(transactions, flagged)
    return base.transform(add_card_features, cards).transform(describe_categories, mcc_codes)
