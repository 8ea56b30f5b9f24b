from datetime import date, datetime

import pytest

from cardlake.functions.dates import with_day_parts
from cardlake.operators.cleaning import CLEANERS, clean_cards
from cardlake.schemas import SILVER

TRANSACTIONS = (
    "id string, date string, client_id string, card_id string, amount string, merchant_id string, "
    "merchant_city string, merchant_state string, zip string, mcc string, errors string, situation_date string"
)


def transaction(number="1", amount="$-77.00", errors=None, city="ONLINE", state=None, day="2025-05-30 10:00:00"):
    return (
        number, "2019-10-31 23:59:00", "1556", "2972.0", amount, "59935", city, state, "58523.0", "5812", errors, day,
    )


def clean(spark, entity, rows, schema):
    return CLEANERS[entity](spark.createDataFrame(rows, schema))


def test_transactions(spark, rows):
    raw = spark.createDataFrame(
        [
            transaction(),
            transaction(),
            transaction(errors="Bad PIN"),
            transaction("2", "$1,234.50", city="Rome", state="GA"),
            transaction("3", ""),
            transaction("4", None),
            transaction("5", "abc"),
            transaction("6", day=None),
        ],
        TRANSACTIONS,
    )
    cleaned = CLEANERS["transactions"](with_day_parts(raw))
    declared = spark.createDataFrame([], SILVER["transactions"])
    assert dict(cleaned.dtypes) == dict(declared.dtypes)
    assert rows(cleaned, "id", "amount_usd") == [(1, -77.0), (2, 1234.5), (3, None), (4, None), (5, None), (6, -77.0)]
    assert tuple(cleaned.where("id = 2").select(*declared.columns).first()) == (
        2, datetime(2019, 10, 31, 23, 59), 1556, 2972, 1234.5, 59935, "Rome", "GA", 58523.0, 5812,
        date(2025, 5, 30), 2025, 5, 30,
    )


def test_typed_transactions_from_a_database(spark, rows):
    raw = spark.sql(
        "SELECT 7 AS id, timestamp'2020-01-02 03:04:05' AS date, 1 AS client_id, 2 AS card_id, '$5.10' AS amount, "
        "3 AS merchant_id, 'X' AS merchant_city, 'Y' AS merchant_state, 4.0D AS zip, 5 AS mcc, 'e' AS errors, "
        "date'2025-05-30' AS situation_date, 'kept' AS use_chip"
    )
    cleaned = CLEANERS["transactions"](raw)
    assert rows(cleaned, "id", "date", "amount_usd", "zip", "use_chip") == [
        (7, datetime(2020, 1, 2, 3, 4, 5), 5.1, 4.0, "kept")
    ]
    assert "errors" not in cleaned.columns


def test_cards(spark, rows):
    schema = (
        "id string, client_id string, card_brand string, card_type string, card_number string, cvv string, "
        "has_chip string, num_cards_issued string, credit_limit string, year_pin_last_changed string, "
        "card_on_dark_web string"
    )

    def card(number, chip, dark):
        return (number, "825", "Visa", "Debit", "4344676511950444", "623", chip, "2", "$24,295", "2008", dark)

    given = [card("1", "YES", "No"), card("01", "YES", "No"), card("2", "NO", "Yes"), card("3", "yes", "?")]
    cleaned = clean(spark, "cards", given, schema)
    exact = clean_cards(spark.createDataFrame(given + [card("4", "No", "NO")], schema), exact_case=True)
    assert rows(exact, "id", "has_chip", "card_on_dark_web") == [
        (1, True, False),
        (2, False, True),
        (3, None, None),
        (4, None, None),
    ]
    assert rows(cleaned, "id", "card_number", "has_chip", "card_on_dark_web", "credit_limit_usd", "cvv") == [
        (1, 4344676511950444, True, False, 24295.0, 623),
        (2, 4344676511950444, False, True, 24295.0, 623),
        (3, 4344676511950444, True, None, 24295.0, 623),
    ]


def test_users(spark, rows):
    schema = (
        "id string, current_age string, retirement_age string, birth_year string, gender string, latitude string, "
        "longitude string, per_capita_income string, num_credit_cards string"
    )

    def user(number, gender):
        return (number, "53", "66", "1966", gender, "34.15", "-117.76", "$29,278", "5")

    cleaned = clean(
        spark, "users", [user("1", "Male"), user("2", "Female"), user("3", "Other"), user("4", None), user("1", "Male")], schema
    )
    assert rows(cleaned, "id", "gender", "latitude", "longitude", "per_capita_income_usd", "num_credit_cards") == [
        (1, "M", 34.15, -117.76, 29278.0, "5"),
        (2, "F", 34.15, -117.76, 29278.0, "5"),
        (3, None, 34.15, -117.76, 29278.0, "5"),
        (4, None, 34.15, -117.76, 29278.0, "5"),
    ]


def test_codes_and_labels(spark, rows):
    codes = clean(spark, "mcc_codes", [("5812", "Eating"), ("5812", "Eating"), ("x1", "odd")], "mcc_code string, description string")
    assert rows(codes) == [(5812, "Eating"), (None, "odd")]
    labels = clean(spark, "train_fraud_labels", [("1", "Yes"), ("01", "Yes"), ("1", "No"), ("2", "1")], "id string, label string")
    assert rows(labels) == [(1, "No"), (1, "Yes"), (2, "1")]


def test_ids_above_the_int_range_survive(spark, rows):
    labels = clean(spark, "train_fraud_labels", [("3000000000", "Yes")], "id string, label string")
    assert rows(labels) == [(3_000_000_000, "Yes")]


@pytest.mark.parametrize("entity", sorted(SILVER))
def test_copies_are_merged_before_the_shuffle(spark, entity):
    columns = {field.name for field in spark.createDataFrame([], SILVER[entity]).schema}
    raw_names = {"amount_usd": "amount", "credit_limit_usd": "credit_limit", "per_capita_income_usd": "per_capita_income"}
    raw = spark.createDataFrame([], ", ".join(f"{raw_names.get(c, c)} string" for c in sorted(columns)))
    plan = CLEANERS[entity](raw)._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange hashpartitioning", 1)
    assert "HashAggregate" in before and "HashAggregate" in after
    assert plan.count("Exchange") == 1
