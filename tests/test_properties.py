"""Marts against plain Python on random small tables, and totals on the given tables."""

from collections import Counter, defaultdict

from conftest import SF_DIR
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardlake.operators import joins
from cardlake.plans.gold import build_marts
from registry.bindings import typed

ids = st.one_of(st.none(), st.integers(0, 6))
cents = st.one_of(st.none(), st.integers(-10**9, 10**9))
name = st.sampled_from(["A", "B", None])
transactions = st.lists(st.tuples(ids, cents, name, name, st.one_of(st.none(), st.integers(1, 4))), max_size=25)
labels = st.lists(st.tuples(ids, st.sampled_from(["Yes", "No", "1", None])), max_size=12)
codes = st.lists(st.tuples(st.integers(1, 5), st.sampled_from(["x", "y", "z"])), max_size=5)


def counted(df):
    return Counter({tuple(row)[:-1]: tuple(row)[-1] for row in df.collect()})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(transactions, labels, codes)
def test_marts_equal_plain_python(spark, facts, known, mcc):
    make = spark.createDataFrame
    marts = build_marts(
        transactions=make(
            [(i, c / 100 if c is not None else None, city, state, m) for i, c, city, state, m in facts],
            "id bigint, amount_usd double, merchant_city string, merchant_state string, mcc int",
        ),
        labels=make(known, "id bigint, label string"),
        users=make([], "id bigint, gender string, num_credit_cards string"),
        cards=make([], "id bigint, client_id bigint, card_brand string, card_type string, credit_limit_usd double"),
        mcc_codes=make(mcc, "mcc_code int, description string"),
    )
    frauds, totals, categories = Counter(), defaultdict(lambda: None), Counter()
    for number, amount, city, state, code in facts:
        matching = [label for i, label in known if i == number and number is not None] or [None]
        for label in matching:
            frauds[city, int(label in ("Yes", "1"))] += 1
        totals[state] = totals[state] if amount is None else (totals[state] or 0) + amount
        for description in [d for c, d in mcc if c == code] or [None]:
            categories[(description,)] += 1
    assert counted(marts["dm_fraude_detection"]) == frauds
    assert counted(marts["dm_mcc_categories"]) == categories
    sums = {row["merchant_state"]: row["total_usd"] for row in marts["dm_transactions_par_region"].collect()}
    assert sums == {state: None if total is None else total / 100 for state, total in totals.items()}


def test_mart_totals_equal_the_facts(spark):
    facts, known, users, cards, mcc = (
        typed(spark, SF_DIR, entity) for entity in ("transactions", "fraud_labels", "users", "cards", "mcc_codes")
    )
    marts = build_marts(facts, known, users, cards, mcc)

    def total(mart, column):
        return marts[mart].agg(F.sum(column)).first()[0]

    assert total("dm_fraude_detection", "nb_transactions") == joins.label_transactions(facts, known).count()
    assert total("dm_mcc_categories", "nb_trans") == facts.count()
    assert total("dm_cartes", "nb_cartes") == cards.count()
    exact = facts.agg(F.sum(F.col("amount_usd").cast("decimal(18,2)"))).first()[0]
    assert round(total("dm_transactions_par_region", "total_usd"), 2) == float(exact)
