"""Gold: Silver tables to the five marts, stored as Parquet tables and, if wanted, sent over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardlake.operators import marts
from cardlake.operators.joins import FRAUD_VALUES, label_transactions
from cardlake.session import stored
from cardlake.sinks.relational import write_jdbc
from cardlake.sinks.tables import write_table
from cardlake.sinks.versions import read_current


def build_marts(
    transactions: DataFrame,
    labels: DataFrame,
    users: DataFrame,
    cards: DataFrame,
    mcc_codes: DataFrame,
    fraud_values: tuple[str, ...] = FRAUD_VALUES,
    count_per_label: bool = False,
) -> dict[str, DataFrame]:
    """The marts by name, each reading only its own columns.

    Region and category marts need no labels, so they skip the label join. ``count_per_label``
    computes them after it, where a transaction with several labels counts several times; the joined
    columns are then stored once for all three marts. The two marts share one roll-up of the
    transactions, which is stored too, so that the transactions are read once for both.
    """
    labelled = label_transactions(transactions, labels, fraud_values)
    if count_per_label:
        labelled = stored(labelled.select("merchant_city", "is_fraud", "merchant_state", "mcc", "amount_usd"), "labelled")
    rolled = stored(marts.per_state_and_code(labelled if count_per_label else transactions), "rolled")
    return {
        "dm_fraude_detection": marts.dm_fraude_detection(labelled),
        "dm_clients": marts.dm_clients(users, cards),
        "dm_transactions_par_region": marts.dm_transactions_par_region(rolled),
        "dm_cartes": marts.dm_cartes(cards),
        "dm_mcc_categories": marts.dm_mcc_categories(rolled, mcc_codes),
    }


def read_silver(
    spark: SparkSession, entity: str, silver_root: str | None = None, database: str = "silver"
) -> DataFrame:
    """A Silver table by name, or by its folder where no shared catalog keeps the names."""
    return read_current(spark, f"{silver_root}/{entity}") if silver_root else spark.table(f"{database}.{entity}")


def refresh_gold(
    spark: SparkSession,
    gold_root: str,
    silver_root: str | None = None,
    database: str = "gold",
    jdbc_url: str | None = None,
    jdbc_properties: dict[str, str] | None = None,
    connections: int | None = None,
    **options,
) -> list[str]:
    """Write every mart to ``gold.<mart>`` and, with a URL, copy the stored mart to the database there.

    ``connections`` limits the connections of a copy; by default it has as many as the mart has partitions.
    """
    names = []
    silver = {
        argument: read_silver(spark, entity, silver_root)
        for argument, entity in (
            ("transactions", "transactions"),
            ("labels", "train_fraud_labels"),
            ("users", "users"),
            ("cards", "cards"),
            ("mcc_codes", "mcc_codes"),
        )
    }
    for name, mart in build_marts(**silver, **options).items():
        write_table(mart, f"{database}.{name}", f"{gold_root}/{name}", partition_by=None)
        if jdbc_url:
            mart = spark.table(f"{database}.{name}")
            write_jdbc(mart, jdbc_url, name, jdbc_properties or {}, connections=connections)
        names.append(name)
    return names
