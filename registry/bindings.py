"""The given tables as card-transaction entities.

``TYPED`` is plain SQL for both engines: the entities as Silver holds them. ``raw_*`` are Spark frames of
the same rows as unclean text, the way Bronze holds them; the SQL side states what cleaning must give.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CITY = "CASE WHEN l_returnflag = 'N' THEN 'ONLINE' ELSE concat('City ', CAST(l_suppkey % 50 AS STRING)) END"
_STATE = "CASE WHEN l_returnflag <> 'N' THEN concat('S', CAST(l_suppkey % 20 AS STRING)) END"

TYPED = {
    "transactions": f"""
        SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS client_id, l_partkey AS card_id,
               l_extendedprice AS amount_usd, l_suppkey AS merchant_id, {_CITY} AS merchant_city,
               {_STATE} AS merchant_state, l_suppkey AS mcc, l_shipdate AS date
        FROM lineitem""",
    # A fifth of the orders has no label; one in a hundred of the rest has a second one.
    "fraud_labels": """
        SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS label
        FROM orders WHERE o_orderpriority <> '5-LOW'
        UNION ALL
        SELECT o_orderkey AS id, '1' AS label
        FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 100 = 7""",
    "cards": """
        SELECT p_partkey AS id, p_partkey - p_partkey % 2 AS client_id, p_brand AS card_brand, p_type AS card_type,
               p_retailprice AS credit_limit_usd, p_size % 2 = 0 AS has_chip
        FROM part""",
    "users": """
        SELECT c_custkey AS id,
               CASE WHEN c_nationkey % 3 = 0 THEN 'M' WHEN c_nationkey % 3 = 1 THEN 'F' END AS gender,
               CAST(c_nationkey AS STRING) AS num_credit_cards
        FROM customer""",
    # A fifth of the codes is unknown.
    "mcc_codes": """
        SELECT s_suppkey AS mcc_code, s_name AS description FROM supplier WHERE s_suppkey % 5 <> 0""",
    # Few enough descriptions for the model: the nation of the supplier.
    "mcc_groups": """
        SELECT s_suppkey AS mcc_code, n_name AS description
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0""",
}


def with_typed(*names: str) -> str:
    """WITH clause that defines entities for the SQL side."""
    return "WITH " + ", ".join(f"{name} AS ({TYPED[name]})" for name in names) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for name in set(re.findall(r"(?:FROM|JOIN) (\w+)", text)):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def typed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _sql(spark, sf_dir, TYPED[name])


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text. Days 28 to 30 by id; every fourth line comes twice, differing only in ``errors``."""

    def rows(errors: str, condition: str) -> str:
        return f"""
            SELECT CAST(l_orderkey AS STRING) AS id, CAST(l_shipdate AS STRING) AS date,
                   CAST(l_partkey AS STRING) AS client_id,
                   concat(CAST(l_partkey AS STRING), CASE WHEN l_linenumber = 2 THEN '.0' ELSE '' END) AS card_id,
                   CASE WHEN l_linenumber = 7 AND l_suppkey % 10 = 0 THEN 'abc'
                        WHEN l_linenumber = 7 AND l_suppkey % 10 = 1 THEN ''
                        WHEN l_linenumber = 7 AND l_suppkey % 10 = 2 THEN NULL
                        WHEN l_returnflag = 'R' THEN concat('$-', format_number(l_extendedprice, 2))
                        ELSE concat('$', format_number(l_extendedprice, 2)) END AS amount,
                   CAST(l_suppkey AS STRING) AS merchant_id, {_CITY} AS merchant_city, {_STATE} AS merchant_state,
                   CASE WHEN l_returnflag <> 'N' THEN concat(CAST(10000 + l_suppkey AS STRING), '.0') END AS zip,
                   concat(' ', CAST(l_suppkey AS STRING)) AS mcc, {errors} AS errors,
                   concat('2025-05-', CAST(28 + l_orderkey % 3 AS STRING), ' 10:15:00') AS situation_date
            FROM lineitem WHERE {condition}"""

    once = rows("CASE WHEN l_linenumber = 3 THEN 'Bad PIN' END", "true")
    return _sql(spark, sf_dir, f"{once} UNION ALL {rows(chr(39) + 'Technical Glitch' + chr(39), 'l_linenumber = 4')}")


# What cleaning must make of one raw transaction, from the typed columns.
CLEAN_TRANSACTION = f"""
    l_orderkey AS id, l_shipdate AS date, l_partkey AS client_id, l_partkey AS card_id,
    CASE WHEN l_linenumber = 7 AND l_suppkey % 10 <= 2 THEN NULL
         WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount_usd,
    l_suppkey AS merchant_id, {_CITY} AS merchant_city, {_STATE} AS merchant_state,
    CASE WHEN l_returnflag <> 'N' THEN CAST(10000 + l_suppkey AS DOUBLE) END AS zip,
    CAST(l_suppkey AS INTEGER) AS mcc"""


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text. Every fifth card comes twice, the second time with a leading zero in its id."""

    def rows(card_id: str, condition: str) -> str:
        return f"""
            SELECT {card_id} AS id, CAST(p_partkey - p_partkey % 2 AS STRING) AS client_id, p_brand AS card_brand,
                   p_type AS card_type, CAST(4000000000000000 + p_partkey AS STRING) AS card_number,
                   CAST(100 + p_size AS STRING) AS cvv,
                   CASE p_size % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'yes' ELSE '?' END AS has_chip,
                   CAST(p_size % 3 + 1 AS STRING) AS num_cards_issued,
                   concat('$', format_number(p_retailprice, 2)) AS credit_limit,
                   CAST(2000 + p_size AS STRING) AS year_pin_last_changed,
                   CASE p_size % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS card_on_dark_web
            FROM part WHERE {condition}"""

    plain = rows("CAST(p_partkey AS STRING)", "true")
    return _sql(spark, sf_dir, f"{plain} UNION ALL {rows('concat(0, CAST(p_partkey AS STRING))', 'p_partkey % 5 = 0')}")


CLEAN_CARDS = """
    SELECT p_partkey AS id, p_partkey - p_partkey % 2 AS client_id, p_brand AS card_brand, p_type AS card_type,
           4000000000000000 + p_partkey AS card_number, CAST(100 + p_size AS INTEGER) AS cvv,
           CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS has_chip,
           CAST(p_size % 3 + 1 AS INTEGER) AS num_cards_issued, p_retailprice AS credit_limit_usd,
           CAST(2000 + p_size AS INTEGER) AS year_pin_last_changed,
           CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS card_on_dark_web
    FROM part"""


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text. Every third user comes twice."""

    def rows(condition: str) -> str:
        return f"""
            SELECT CAST(c_custkey AS STRING) AS id, CAST(18 + c_nationkey AS STRING) AS current_age,
                   concat(CAST(60 + c_nationkey % 10 AS STRING), '.5') AS retirement_age,
                   CAST(2007 - c_nationkey AS STRING) AS birth_year,
                   CASE c_nationkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Other' END AS gender,
                   CAST(c_acctbal / 200 AS STRING) AS latitude, CAST(c_acctbal / 100 AS STRING) AS longitude,
                   concat('$', format_number(c_acctbal, 2)) AS per_capita_income,
                   CAST(c_nationkey % 5 AS STRING) AS num_credit_cards
            FROM customer WHERE {condition}"""

    return _sql(spark, sf_dir, f"{rows('true')} UNION ALL {rows('c_custkey % 3 = 0')}")


CLEAN_USERS = """
    SELECT c_custkey AS id, CAST(18 + c_nationkey AS INTEGER) AS current_age,
           CAST(60 + c_nationkey % 10 AS INTEGER) AS retirement_age, CAST(2007 - c_nationkey AS INTEGER) AS birth_year,
           CASE c_nationkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender,
           c_acctbal / 200 AS latitude, c_acctbal / 100 AS longitude, c_acctbal AS per_capita_income_usd,
           CAST(c_nationkey % 5 AS STRING) AS num_credit_cards
    FROM customer"""


def raw_mcc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text. Some keys are no numbers; some rows come twice."""

    def rows(condition: str) -> str:
        return f"""
            SELECT CASE WHEN s_suppkey % 10 = 9 THEN concat('X', CAST(s_suppkey AS STRING))
                        ELSE CAST(s_suppkey AS STRING) END AS mcc_code, s_name AS description
            FROM supplier WHERE {condition}"""

    return _sql(spark, sf_dir, f"{rows('true')} UNION ALL {rows('s_suppkey % 4 = 0')}")


CLEAN_MCC_CODES = """
    SELECT CASE WHEN s_suppkey % 10 <> 9 THEN CAST(s_suppkey AS INTEGER) END AS mcc_code, s_name AS description
    FROM supplier"""


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text: the labels, a third of them twice."""
    labels = TYPED["fraud_labels"]
    return _sql(
        spark,
        sf_dir,
        f"SELECT CAST(id AS STRING) AS id, label FROM ({labels}) UNION ALL "
        f"SELECT concat('0', CAST(id AS STRING)) AS id, label FROM ({labels}) WHERE id % 3 = 0",
    )


CLEAN_LABELS = TYPED["fraud_labels"]

RAW = {
    "transactions": raw_transactions,
    "cards": raw_cards,
    "users": raw_users,
    "mcc_codes": raw_mcc_codes,
    "train_fraud_labels": raw_labels,
}
