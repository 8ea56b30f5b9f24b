"""Typing of raw text. Unreadable text becomes null, also when ANSI mode is on.

A failing ``try_cast`` of a number costs as much as a hundred good ones, because it throws inside the
engine. So text is matched against a pattern first, and only text of the right form is cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(name: str, type_name: str) -> Column:
    """Whole number of a text; a fraction is cut off, so "12.0" and "12.7" both read as 12."""
    text = F.col(name)
    digits = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text).when(
        text.rlike(r"^\s*[+-]?\d+\.\d*\s*$"), F.substring_index(text, ".", 1)
    )
    return digits.try_cast(type_name)


def to_int(name: str) -> Column:
    return _whole(name, "int")


def to_long(name: str) -> Column:
    return _whole(name, "bigint")


def _decimal_number(text: Column) -> Column:
    """Double of a decimal text; words that Java reads as numbers (NaN, 1d) are null."""
    is_number = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(is_number, text).try_cast("double")


def to_double(name: str) -> Column:
    return _decimal_number(F.col(name))


def _dated(name: str) -> Column:
    """The text if it begins with a year, a month and a day; a cast would fill in what is missing."""
    return F.when(F.col(name).rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$"), F.col(name))


def to_timestamp(name: str) -> Column:
    return _dated(name).try_cast("timestamp")


def to_day(name: str) -> Column:
    """Date of ``yyyy-MM-dd`` text, with or without a time of day behind it; text without a day is null."""
    return _dated(name).try_cast("date")


_FROM_TEXT = {"int": to_int, "bigint": to_long, "double": to_double, "timestamp": to_timestamp, "date": to_day}


def typed(df: DataFrame, types: dict[str, str]) -> dict[str, Column]:
    """Each named column in its type; text is parsed, columns that already have a type are cast."""
    given = dict(df.dtypes)
    return {
        name: _FROM_TEXT[target](name) if given[name] == "string" else F.col(name).try_cast(target)
        for name, target in types.items()
    }


def money(name: str) -> Column:
    """``$-1,234.50`` as -1234.5."""
    return _decimal_number(F.translate(F.col(name), "$,", ""))


def flag(name: str, yes: str = "YES", no: str = "NO", exact_case: bool = False) -> Column:
    """Nullable boolean of a yes/no text; any other text is null."""
    text = F.col(name) if exact_case else F.upper(F.trim(F.col(name)))
    if not exact_case:
        yes, no = yes.upper(), no.upper()
    return F.when(text == yes, True).when(text == no, False)


def gender_code(name: str, exact_case: bool = False) -> Column:
    """M or F; any other text is null."""
    is_male = flag(name, "Male", "Female", exact_case)
    return F.when(is_male, "M").when(~is_male, "F")


def fraud_flag(label: str, fraud_values: tuple[str, ...] = ("Yes", "1")) -> Column:
    """1 for a fraud label, else 0; a missing label counts as no fraud."""
    return F.when(F.col(label).isin(*fraud_values), 1).otherwise(0)
