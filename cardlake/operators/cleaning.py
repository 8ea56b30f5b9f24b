"""Silver: typing, cleaning and whole-row deduplication of each entity.

Duplicates are removed after cleaning, so rows that only differed in spelling or in a dropped column
become one. Copies are merged before the shuffle: many copies of one row never meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cardlake.functions.casts import flag, gender_code, money, typed


def clean_transactions(raw: DataFrame) -> DataFrame:
    types = {
        "id": "bigint",
        "date": "timestamp",
        "client_id": "bigint",
        "card_id": "bigint",
        "situation_date": "date",
        "merchant_id": "bigint",
        "zip": "double",
        "mcc": "int",
    }
    cleaned = raw.drop("errors").withColumns({**typed(raw, types), "amount": money("amount")})
    return cleaned.withColumnRenamed("amount", "amount_usd").dropDuplicates()


def clean_cards(raw: DataFrame, exact_case: bool = False) -> DataFrame:
    """``exact_case`` reads the flags only as YES/NO (chip) and Yes/No (dark web)."""
    types = {
        "id": "bigint",
        "client_id": "bigint",
        "card_number": "bigint",
        "cvv": "int",
        "num_cards_issued": "int",
        "year_pin_last_changed": "int",
    }
    cleaned = raw.withColumns(
        {
            **typed(raw, types),
            "has_chip": flag("has_chip", "YES", "NO", exact_case),
            "card_on_dark_web": flag("card_on_dark_web", "Yes", "No", exact_case),
            "credit_limit": money("credit_limit"),
        }
    )
    return cleaned.withColumnRenamed("credit_limit", "credit_limit_usd").dropDuplicates()


def clean_users(raw: DataFrame, exact_case: bool = False) -> DataFrame:
    """``exact_case`` reads the gender only as Male/Female."""
    types = {
        "id": "bigint",
        "current_age": "int",
        "retirement_age": "int",
        "birth_year": "int",
        "latitude": "double",
        "longitude": "double",
    }
    cleaned = raw.withColumns(
        {
            **typed(raw, types),
            "gender": gender_code("gender", exact_case),
            "per_capita_income": money("per_capita_income"),
        }
    )
    return cleaned.withColumnRenamed("per_capita_income", "per_capita_income_usd").dropDuplicates()


def clean_mcc_codes(raw: DataFrame) -> DataFrame:
    return raw.withColumns(typed(raw, {"mcc_code": "int"})).dropDuplicates()


def clean_labels(raw: DataFrame) -> DataFrame:
    return raw.withColumns(typed(raw, {"id": "bigint"})).dropDuplicates()


CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "transactions": clean_transactions,
    "cards": clean_cards,
    "users": clean_users,
    "mcc_codes": clean_mcc_codes,
    "train_fraud_labels": clean_labels,
}
