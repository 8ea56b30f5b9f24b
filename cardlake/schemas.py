"""Declared columns per entity and layer.

Identifiers are bigint: an int column would turn ids above 2^31 - 1 into nulls.
Columns that are not named here pass through Bronze and Silver untouched.
"""

from __future__ import annotations

DAY_PARTS = ["year", "month", "day"]

SILVER = {
    "transactions": (
        "id bigint, date timestamp, client_id bigint, card_id bigint, amount_usd double, merchant_id bigint, "
        "merchant_city string, merchant_state string, zip double, mcc int, situation_date date, "
        "year int, month int, day int"
    ),
    "cards": (
        "id bigint, client_id bigint, card_brand string, card_type string, card_number bigint, cvv int, "
        "has_chip boolean, num_cards_issued int, credit_limit_usd double, year_pin_last_changed int, "
        "card_on_dark_web boolean, year int, month int, day int"
    ),
    "users": (
        "id bigint, current_age int, retirement_age int, birth_year int, gender string, latitude double, "
        "longitude double, per_capita_income_usd double, num_credit_cards string, year int, month int, day int"
    ),
    "mcc_codes": "mcc_code int, description string, year int, month int, day int",
    "train_fraud_labels": "id bigint, label string, year int, month int, day int",
}

GOLD = {
    "dm_fraude_detection": "merchant_city string, is_fraud int, nb_transactions bigint",
    "dm_clients": "user_id bigint, gender string, credit_limit_usd double, num_credit_cards string",
    "dm_transactions_par_region": "merchant_state string, total_usd double",
    "dm_cartes": "card_brand string, card_type string, nb_cartes bigint",
    "dm_mcc_categories": "description string, nb_trans bigint",
}

LABEL_RECORDS = "id string, label string"

SCORING_INPUT = (
    "amount_usd double, credit_limit_usd double, merchant_state string, card_brand string, "
    "card_type string, has_chip string, description string"
)
