"""The jobs from source files to marts, as the command line runs them."""

import json
from unittest import mock

import pytest
from pyspark.sql import DataFrameReader, DataFrameWriter

from cardlake import __main__ as cli
from cardlake.plans import silver

TRANSACTIONS = [
    (1, "2019-10-31 23:59:00", 825, 10, "$100.10", 1, "ONLINE", None, None, 5812, None, "2025-05-29 08:00:00"),
    (1, "2019-10-31 23:59:00", 825, 10, "$100.10", 1, "ONLINE", None, None, 5812, None, "2025-05-30 08:00:00"),
    (2, "2019-10-31 23:59:00", 825, 10, "$-20.05", 2, "Rome", "GA", 30161.0, 5812, "Bad PIN", "2025-05-30 08:00:00"),
    (2, "2019-10-31 23:59:00", 825, 10, "$-20.05", 2, "Rome", "GA", 30161.0, 5812, None, "2025-05-30 08:00:00"),
    (8, "2019-10-31 23:59:00", 2, 11, "$1,000.00", 3, "Rome", "GA", 30161.0, 1, None, "2025-05-30 08:00:00"),
]
SCHEMA = (
    "id int, date string, client_id int, card_id int, amount string, merchant_id int, merchant_city string, "
    "merchant_state string, zip double, mcc int, errors string, situation_date string"
)


@pytest.fixture
def source(spark, tmp_path):
    """Source files and a stand-in for the relational table; no database is started."""
    folder = tmp_path / "source"
    folder.mkdir()
    (folder / "cards.csv").write_text(
        "id,client_id,card_brand,card_type,card_number,cvv,has_chip,num_cards_issued,credit_limit,"
        "year_pin_last_changed,card_on_dark_web\n"
        '10,825,Visa,Debit,4344676511950444,623,YES,2,"$24,295",2008,No\n'
        "11,2,Amex,Credit,4344676511950445,624,NO,1,$500,2010,No\n"
    )
    (folder / "users.csv").write_text(
        "id,current_age,retirement_age,birth_year,gender,latitude,longitude,per_capita_income,num_credit_cards\n"
        '825,53,66,1966,Female,34.15,-117.76,"$29,278",5\n2,30,66,1990,Male,1.5,2.5,$10,1\n'
    )
    (folder / "mcc.json").write_text('{"5812": "Eating Places", "5411": "Grocery"}')
    (folder / "labels.json").write_text('{"target": {"1": "Yes", "2": "No"}}')
    (folder / "jdbc.json").write_text('{"user": "u", "password": "p"}')
    table = spark.createDataFrame(TRANSACTIONS, SCHEMA)

    def read(reader, url, table_name=None, predicates=None, properties=None, **named):
        assert properties["password"] == "p"
        if predicates is None:
            table.createOrReplaceTempView("transactions")
            return spark.sql(f"SELECT * FROM {named['table']}")
        assert named["table"] == "transactions"
        return table.where(" OR ".join(f"({p})" for p in predicates))

    with mock.patch.object(DataFrameReader, "jdbc", read):
        yield folder


def run(spark, *argv):
    args = cli.parse([str(a) for a in argv])
    args.action(spark, args)


def bronze_arguments(source, bronze, *more):
    return (
        "bronze", "--bronze", bronze, "--day", "2025-05-30", "--jdbc-url", "jdbc:x",
        "--jdbc-properties", source / "jdbc.json", "--size", 3,
        "--cards", source / "cards.csv", "--users", source / "users.csv",
        "--mcc-codes", source / "mcc.json", "--labels", source / "labels.json", *more,
    )


def test_from_sources_to_marts(spark, source, tmp_path, rows):
    bronze, gold = tmp_path / "bronze", tmp_path / "gold"
    run(spark, *bronze_arguments(source, bronze))
    run(spark, *bronze_arguments(source, bronze, "--ranges", 2))
    assert spark.read.parquet(f"{bronze}/transactions").count() == 5
    assert (bronze / "cards" / "year=2025" / "month=05" / "day=30").is_dir()

    run(spark, "silver", "--bronze", bronze, "--silver", tmp_path / "silver")
    assert rows(spark.table("silver.transactions"), "id", "amount_usd", "day") == [
        (1, 100.1, 30), (2, -20.05, 30), (8, 1000.0, 30),
    ]
    sent = {}

    def write(writer, url, table, mode=None, properties=None):
        sent[table] = (mode, writer._df.count())

    with mock.patch.object(DataFrameWriter, "jdbc", write):
        run(
            spark, "gold", "--gold", gold, "--silver", tmp_path / "silver",
            "--jdbc-url", "jdbc:x", "--jdbc-properties", source / "jdbc.json",
        )
    assert rows(spark.table("gold.dm_fraude_detection")) == [("ONLINE", 1, 1), ("Rome", 0, 2)]
    assert rows(spark.table("gold.dm_transactions_par_region")) == [("GA", 979.95), (None, 100.1)]
    assert rows(spark.table("gold.dm_mcc_categories")) == [("Eating Places", 2), (None, 1)]
    assert rows(spark.table("gold.dm_clients")) == [(2, "M", 500.0, "1"), (825, "F", 24295.0, "5")]
    assert sent == {
        "dm_fraude_detection": ("overwrite", 2),
        "dm_clients": ("overwrite", 2),
        "dm_transactions_par_region": ("overwrite", 2),
        "dm_cartes": ("overwrite", 2),
        "dm_mcc_categories": ("overwrite", 2),
    }

    export = tmp_path / "export"
    run(spark, "query", "--gold", gold, "--sql", "SELECT * FROM dm_cartes", "--output", export)
    exported = spark.read.option("header", True).csv(f"{export}/*")
    assert rows(exported) == [("Amex", "Credit", "1"), ("Visa", "Debit", "1")]


def test_a_window_of_ids_is_appended_and_says_what_it_leaves_out(spark, source, tmp_path, caplog):
    window = bronze_arguments(source, tmp_path / "bronze", "--start", 0, "--end", 6)
    with pytest.raises(ValueError, match="whole days"):
        run(spark, *window)
    with caplog.at_level("WARNING", logger="cardlake"):
        run(spark, *window, "--mode", "append")
    assert "1 transactions are outside the window" in caplog.text
    assert spark.read.parquet(f"{tmp_path}/bronze/transactions").count() == 4
    run(spark, *bronze_arguments(source, tmp_path / "whole", "--start", 0, "--end", 6, "--everything"))
    assert spark.read.parquet(f"{tmp_path}/whole/transactions").count() == 5
    with pytest.raises(ValueError, match="both"):
        run(spark, *bronze_arguments(source, tmp_path / "bronze", "--start", 0))


def test_all_days_mode_keeps_every_snapshot(spark, source, tmp_path, rows):
    bronze = tmp_path / "bronze"
    run(spark, *bronze_arguments(source, bronze))
    everything = silver.build_entity(spark, str(bronze), "transactions", mode="all")
    assert rows(everything, "id", "day") == [(1, 29), (1, 30), (2, 30), (8, 30)]
    n = silver.refresh_entity(
        spark, str(bronze), f"{tmp_path}/silver", "transactions", "all", keep_other_days=True, database="every_day"
    )
    assert n == 4
    assert rows(spark.table("every_day.transactions"), "id", "day") == [(1, 29), (1, 30), (2, 30), (8, 30)]


def test_missing_bronze_stops_the_job(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run(spark, "silver", "--bronze", tmp_path, "--silver", tmp_path / "silver")


def test_source_is_filled_with_two_snapshots(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,amount\n" + "".join(f"{i},$1\n" for i in range(200)))
    (tmp_path / "jdbc.json").write_text(json.dumps({"user": "u"}))
    writes = []

    def write(writer, url, table, mode=None, properties=None):
        writes.append((table, mode, writer._df.count(), writer._df.select("situation_date").distinct().count()))

    with mock.patch.object(DataFrameWriter, "jdbc", write):
        run(spark, "load-source", "--csv", tmp_path / "t.csv", "--jdbc-url", "jdbc:x",
            "--jdbc-properties", tmp_path / "jdbc.json", "--schema", "id int, amount string")
    (_, first_mode, first_rows, _), second = writes
    assert first_mode == "overwrite" and first_rows == 100
    assert second == ("transactions", "append", 200, 1)


def test_train_and_score(spark, tmp_path):
    folder = f"{tmp_path}/silver"
    spark.range(2000).selectExpr(
        "id", "id % 7 AS card_id", "if(id % 3 = 0, 900.0D, 1.0D) + id % 5 AS amount_usd", "'NY' AS merchant_state",
        "cast(id % 4 as int) AS mcc",
    ).write.parquet(f"{folder}/transactions")
    spark.range(2000).selectExpr("id", "if(id % 3 = 0, 'Yes', 'No') AS label").write.parquet(f"{folder}/train_fraud_labels")
    spark.range(7).selectExpr(
        "id", "'Visa' AS card_brand", "'Debit' AS card_type", "id % 2 = 0 AS has_chip", "100.0D AS credit_limit_usd"
    ).write.parquet(f"{folder}/cards")
    spark.range(3).selectExpr("cast(id as int) AS mcc_code", "concat('c', id) AS description").write.parquet(f"{folder}/mcc_codes")
    model, scores = f"{tmp_path}/model", f"{tmp_path}/scores"
    run(spark, "train", "--silver", folder, "--model", model, "--max-iter", 2)

    spark.sql(
        "SELECT 77 AS id, 901.0D AS amount_usd, 100.0D AS credit_limit_usd, 'NY' AS merchant_state, 'Visa' AS card_brand, "
        "'Debit' AS card_type, '1' AS has_chip, 'c1' AS description"
    ).write.parquet(f"{tmp_path}/input")
    run(spark, "score", "--model", model, "--input", f"{tmp_path}/input", "--output", scores)
    scored = spark.read.parquet(scores).first()
    assert (scored["id"], scored["prediction"]) == (77, 1.0)
    run(spark, "train", "--silver", folder, "--model", model, "--max-iter", 1, "--fraud-values", "No", "--keep-one-in", 1, "--seed", 7,
        "--train-percent", 90, "--parts", 3)


def test_connections_are_an_option_of_both_jobs(spark, source, tmp_path):
    (tmp_path / "t.csv").write_text("id,amount\n" + "".join(f"{i},$1\n" for i in range(200)))
    parts = []

    def write(writer, url, table, mode=None, properties=None):
        parts.append(writer._df.rdd.getNumPartitions())

    load = ("load-source", "--csv", tmp_path / "t.csv", "--jdbc-url", "jdbc:x", "--jdbc-properties", source / "jdbc.json")
    with mock.patch.object(DataFrameWriter, "jdbc", write):
        run(spark, *load, "--connections", 1)
        assert parts == [1, 1]
        run(spark, *bronze_arguments(source, tmp_path / "bronze"))
        run(spark, "silver", "--bronze", tmp_path / "bronze", "--silver", tmp_path / "silver")
        run(spark, "gold", "--gold", tmp_path / "gold", "--silver", tmp_path / "silver", "--jdbc-url", "jdbc:x", "--connections", 1,
            "--count-per-label", "--fraud-values", "Yes")
    assert set(parts) == {1} and len(parts) == 7
