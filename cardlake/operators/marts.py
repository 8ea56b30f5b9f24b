"""Gold: the five marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.functions.sums import sum_parts, total_of_parts
from cardlake.operators.joins import clients_with_cards, describe_categories


def dm_fraude_detection(labelled: DataFrame) -> DataFrame:
    """Transactions per merchant city and fraud flag; a missing city is a group."""
    return labelled.groupBy("merchant_city", "is_fraud").agg(F.count("*").alias("nb_transactions"))


def dm_clients(users: DataFrame, cards: DataFrame) -> DataFrame:
    """Profile and credit limit per owned card."""
    return clients_with_cards(users, cards)


def per_state_and_code(transactions: DataFrame) -> DataFrame:
    """Amount, in parts, and number of transactions per merchant state and category code.

    One pass over the transactions; the region and the category mart are both sums over its rows.
    """
    return transactions.groupBy("merchant_state", "mcc").agg(*sum_parts("amount_usd"), F.count("*").alias("n"))


def dm_transactions_par_region(rolled: DataFrame) -> DataFrame:
    """Amount per merchant state, from ``per_state_and_code``; missing amounts are skipped, a missing state is a group.

    Roll up plain transactions. Rows joined with labels count an amount once per label.
    """
    return rolled.groupBy("merchant_state").agg(total_of_parts().alias("total_usd"))


def dm_cartes(cards: DataFrame) -> DataFrame:
    """Cards per brand and type."""
    return cards.groupBy("card_brand", "card_type").agg(F.count("*").alias("nb_cartes"))


def dm_mcc_categories(rolled: DataFrame, mcc_codes: DataFrame) -> DataFrame:
    """Transactions per category description, from ``per_state_and_code``; unknown codes count under null.

    Transactions are counted per code before the join, so only one row per code is joined. The
    counts add up to the same totals, also where a code has several descriptions.
    """
    per_code = rolled.groupBy("mcc").agg(F.sum("n").alias("n"))
    described = describe_categories(per_code, mcc_codes)
    return described.groupBy("description").agg(F.sum("n").alias("nb_trans"))
