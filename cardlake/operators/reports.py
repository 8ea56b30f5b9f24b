"""Reports on the marts: roll-ups and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.functions.sums import exact_sum


def state_totals(region_mart: DataFrame) -> DataFrame:
    """Amount per known state, largest first."""
    return region_mart.where("merchant_state IS NOT NULL").orderBy(F.desc("total_usd"), "merchant_state")


def top_cities(fraud_mart: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` cities with most transactions, fraudulent or not."""
    cities = fraud_mart.groupBy("merchant_city").agg(F.sum("nb_transactions").alias("nb_transactions"))
    return cities.orderBy(F.desc("nb_transactions"), "merchant_city").limit(k)


def online_segment(fraud_mart: DataFrame) -> DataFrame:
    """Transactions and frauds of online and of physical merchants."""
    segment = F.when(F.col("merchant_city") == "ONLINE", "ONLINE").otherwise("PHYSICAL")
    frauds = F.when(F.col("is_fraud") == 1, F.col("nb_transactions")).otherwise(0)
    return fraud_mart.groupBy(segment.alias("segment")).agg(
        F.sum("nb_transactions").alias("nb_transactions"), F.sum(frauds).alias("nb_frauds")
    )


def credit_by_gender(client_mart: DataFrame) -> DataFrame:
    """Cards and available credit per gender."""
    return client_mart.groupBy("gender").agg(
        F.count("*").alias("nb_cards"), exact_sum("credit_limit_usd").alias("credit_limit_usd")
    )


def top_categories(category_mart: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` known categories with most transactions."""
    known = category_mart.where("description IS NOT NULL")
    return known.orderBy(F.desc("nb_trans"), "description").limit(k)


def card_mix(card_mart: DataFrame) -> DataFrame:
    """Cards by brand and cards by type, in one pass over the mart."""
    brand, kind = F.col("card_brand"), F.col("card_type")
    return card_mart.groupingSets([[brand], [kind]], brand, kind).agg(
        F.when(F.grouping("card_brand") == 0, "brand").otherwise("type").alias("dimension"),
        F.when(F.grouping("card_brand") == 0, brand).otherwise(kind).alias("value"),
        F.sum("nb_cartes").alias("nb_cartes"),
    ).select("dimension", "value", "nb_cartes")
