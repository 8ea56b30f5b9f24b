"""Registered queries: each Spark query with the DuckDB SQL that must give the same result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.functions.casts import flag, gender_code, money, to_day, to_double, to_int, to_timestamp
from cardlake.functions.dates import with_day_parts
from cardlake.functions.hashing import hash_bucket
from cardlake.operators import indexing, joins, marts, quality, reports, sampling
from cardlake.operators.cleaning import CLEANERS
from cardlake.plans import adhoc, fraud, gold, silver
from cardlake.schemas import SCORING_INPUT
from cardlake.session import scratch_dir, stored
from cardlake.sinks.days import write_by_situation_date, write_ingestion_day
from cardlake.sinks.loads import entries, held_ranges, load_window
from cardlake.sources import days, files, relational, snapshots
from registry import bindings
from registry.bindings import RAW, table, typed, with_typed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def _md5_number(keys: str | list[str], seed: str) -> str:
    """DuckDB text of ``hash_number``."""
    columns = ", ".join(f"CAST({key} AS VARCHAR)" for key in ([keys] if isinstance(keys, str) else keys))
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {columns})), 1, 8) AS BIGINT)"


def _md5_bucket(key: str, buckets: int, seed: str) -> str:
    """DuckDB text of ``hash_bucket``."""
    return f"{_md5_number(key, seed)} % {buckets}"


def _through_catalog(spark: SparkSession, root: str, entity: str, refresh: Callable[[str], object]) -> DataFrame:
    """Rows of a catalog table that ``refresh`` writes into a database of its own, which is dropped again."""
    database = "check_" + root.rsplit("-", 1)[1]
    try:
        refresh(database)
        return stored(spark.table(f"{database}.{entity}"), "table")
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


# ---------------------------------------------------------------- sources


@query(
    "src_csv_roundtrip",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "c_mktsegment FROM customer",
)
def src_csv_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    columns = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    table(spark, sf_dir, "customer").select(*columns).write.mode("overwrite").option("header", True).csv(path)
    return files.read_csv(spark, path)


@query(
    "src_csv_typed",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag, l_shipdate FROM lineitem",
)
def src_csv_typed(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"]
    table(spark, sf_dir, "lineitem").select(*columns).write.mode("overwrite").option("header", True).csv(path)
    schema = (
        "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
    )
    return files.read_csv(spark, path, schema)


@query(
    "src_json_map",
    "SELECT event_id, 'k' AS code, json_extract_string(props, '$.k') AS description FROM events "
    "WHERE json_extract_string(props, '$.k') IS NOT NULL",
)
def src_json_map(spark, sf_dir):
    return files.explode_json_map(table(spark, sf_dir, "events"), "props", "code", "description", keep=("event_id",))


@query(
    "src_json_code_map",
    "SELECT CAST(s_suppkey AS VARCHAR) AS mcc_code, s_name || ', Ltd \"' || CAST(s_nationkey AS VARCHAR) || '\"' "
    "AS description FROM supplier",
)
def src_json_code_map(spark, sf_dir):
    """One JSON object per file; every code is listed twice and the last description counts."""
    path = scratch_dir(spark, "json")
    suppliers = table(spark, sf_dir, "supplier")
    name = F.concat("s_name", F.lit(', Ltd "'), F.col("s_nationkey").cast("string"), F.lit('"'))
    quoted = F.to_json(F.struct(name.alias("v")))
    value = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    entry = F.concat(
        F.lit('"'), F.col("s_suppkey").cast("string"), F.lit('": "old", "'), F.col("s_suppkey").cast("string"),
        F.lit('": '), value,
    )
    # An object of at most 500 codes per file.
    block = F.floor(F.col("s_suppkey") / 500).alias("block")
    objects = suppliers.groupBy(block).agg(F.concat_ws(", ", F.collect_list(entry)).alias("entries"))
    objects = objects.select(F.concat(F.lit("{"), "entries", F.lit("}")).alias("value"), "block")
    objects.write.mode("overwrite").partitionBy("block").text(path)
    return files.read_code_map(spark, path)


@query(
    "src_json_records",
    with_typed("fraud_labels") + "SELECT CAST(id AS VARCHAR) AS id, label FROM fraud_labels",
)
def src_json_records(spark, sf_dir):
    path = scratch_dir(spark, "json")
    labels = typed(spark, sf_dir, "fraud_labels").select(F.col("id").cast("string").alias("id"), "label")
    labels.write.mode("overwrite").json(path)
    return files.read_json(spark, "train_fraud_labels", path, shape="records")


@query(
    "src_json_pairs",
    with_typed("fraud_labels") + "SELECT CAST(id AS VARCHAR) AS id, label FROM fraud_labels",
)
def src_json_pairs(spark, sf_dir):
    """Pieces of one large id-to-label object, split at the commas."""
    path = scratch_dir(spark, "json")
    pair = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": "'), "label", F.lit('",'))
    typed(spark, sf_dir, "fraud_labels").select(pair.alias("value")).write.mode("overwrite").text(path)
    return files.read_json(spark, "train_fraud_labels", path, shape="pairs")


@query(
    "src_json_array",
    with_typed("fraud_labels") + "SELECT CAST(id AS VARCHAR) AS id, label FROM fraud_labels",
)
def src_json_array(spark, sf_dir):
    """Arrays of records over many lines, one to a file; some ids are numbers, and columns come in both orders."""
    path = scratch_dir(spark, "json")
    number = F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"')))
    one = F.concat(F.lit('  {"id": '), number, F.lit(',\n   "label": "'), "label", F.lit('"}'))
    other = F.concat(F.lit('  {"label": "'), F.col("label"), F.lit('", "id": '), number, F.lit(', "more": null}'))
    record = F.when(F.col("id") % 2 == 0, one).otherwise(other)
    # At most 22 000 labels to a file.
    block = F.floor(F.col("id") / 20_000).alias("block")
    arrays = typed(spark, sf_dir, "fraud_labels").select(block, record.alias("record")).groupBy("block")
    arrays = arrays.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("record"), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.mode("overwrite").partitionBy("block").text(path)
    return files.read_json(spark, "train_fraud_labels", path, shape="array").select("id", "label")


_RANGE_START, _RANGE_END, _RANGE_SIZE = -3000, 10_000, 3000


@query(
    "src_id_range_batches",
    """
    WITH rows AS (
        SELECT l_orderkey AS id,
               CASE WHEN l_orderkey < -3000 THEN 'below' WHEN l_orderkey >= 12000 THEN 'above' ELSE 'in range' END
                   AS position
        FROM lineitem),
    counted AS (
        SELECT position, CASE WHEN position = 'in range' THEN CAST(floor(id / 3000.0) AS BIGINT) * 3000 END
                   AS range_start,
               count(*) AS n_rows, min(id) AS min_id, max(id) AS max_id
        FROM rows GROUP BY ALL)
    SELECT 'in range' AS position, r.range AS range_start, coalesce(n_rows, 0) AS n_rows, min_id, max_id,
           n_rows IS NULL AS is_empty
    FROM range(-3000, 10000, 3000) r LEFT JOIN counted ON r.range = range_start
    UNION ALL
    SELECT position, range_start, n_rows, min_id, max_id, false FROM counted WHERE position <> 'in range'
    """,
)
def src_id_range_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return relational.range_counts(rows, "l_orderkey", _RANGE_START, _RANGE_END, _RANGE_SIZE)


def _rows_per_range(rows: DataFrame, id_column: str, ranges: list[tuple[int, int]], missing: bool) -> DataFrame:
    """Rows that each predicate of the relational scan reads; a row that two of them read would count twice.

    The predicates are rows of a table, and a row meets only those that reach into its cell, a stretch of ids as wide as
    the widest range. So the work grows with the rows and the ranges, not with their product.
    """
    predicates = relational.range_predicates(ranges, id_column, missing)
    width = F.lit(max((high - low for low, high in ranges), default=1)).cast("bigint")
    cell = lambda key: key - F.pmod(key, width)
    bound = lambda i: F.regexp_extract("predicate", rf"^{id_column} >= (-?\d+) AND {id_column} < (-?\d+)$", i).try_cast("bigint")
    scans = rows.sparkSession.createDataFrame([(p,) for p in predicates[: len(ranges)]], "predicate string")
    scans = scans.select(bound(1).alias("low"), bound(2).alias("high"))
    scans = scans.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1), width)))
    keyed = rows.select(F.col(id_column).alias("id")).withColumn("cell", cell(F.col("id").cast("bigint")))
    read = keyed.join(scans, "cell").filter("id >= low AND id < high").select("low", "id")
    for predicate in predicates[len(ranges) :]:
        unnamed = rows.filter(predicate).select(F.lit(None).cast("bigint").alias("low"), F.col(id_column).alias("id"))
        read = read.unionByName(unnamed)
    return read.groupBy(F.col("low").alias("range_start")).agg(
        F.count("*").alias("n_rows"), F.sum("id").cast("bigint").alias("sum_id")
    )


_WITH_MISSING = "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderkey END AS id FROM orders"


@query(
    "src_range_predicates",
    f"""
    SELECT CAST(floor((id - 3000) / 250.0) AS BIGINT) * 250 + 3000 AS range_start, count(*) AS n_rows,
           CAST(sum(id) AS BIGINT) AS sum_id
    FROM ({_WITH_MISSING}) GROUP BY 1
    """,
)
def src_range_predicates(spark, sf_dir):
    """A window of ids with the ids on both sides and those that are missing: each row is read by one range."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_WITH_MISSING)
    rows.createOrReplaceTempView("orders_with_missing")
    bounds = relational.view_bounds(spark, "orders_with_missing")
    inside = relational.id_ranges(3000, 4000, 250)
    ranges = sorted(inside + relational.outside_ranges(bounds, inside))
    return _rows_per_range(rows, "id", ranges, bounds.missing > 0)


@query(
    "src_derived_ranges",
    """
    WITH bounds AS (SELECT min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders)
    SELECT least + (o_orderkey - least) // width * width AS range_start, count(*) AS n_rows,
           CAST(sum(o_orderkey) AS BIGINT) AS sum_id
    FROM orders, (SELECT least, (most - least) // 40 + 1 AS width FROM bounds) GROUP BY 1
    """,
)
def src_derived_ranges(spark, sf_dir):
    """Forty ranges from the smallest to the largest id of the table."""
    orders = table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("orders")
    bounds = relational.view_bounds(spark, "orders", "o_orderkey")
    ranges = relational.id_ranges(bounds.least, bounds.most + 1, count=40)
    return _rows_per_range(orders, "o_orderkey", ranges, False)


_HALF = f"""
    SELECT o_orderkey, o_orderpriority FROM (
        SELECT o_orderkey, o_orderpriority,
               row_number() OVER (ORDER BY {_md5_number(["o_orderkey", "o_orderpriority"], "half")},
                                           o_orderkey, o_orderpriority) AS position
        FROM orders)
    WHERE position <= (SELECT count(*) // 2 FROM orders)"""


@query("src_half_snapshot", _HALF)
def src_half_snapshot(spark, sf_dir):
    return snapshots.half_snapshot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))


@query(
    "src_snapshot_stack",
    f"SELECT *, '2025-05-29 08:00:00' AS situation_date FROM ({_HALF}) UNION ALL "
    "SELECT o_orderkey, o_orderpriority, '2025-05-30 08:00:00' AS situation_date FROM orders",
)
def src_snapshot_stack(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return snapshots.stack_snapshots(rows, "2025-05-29 08:00:00", "2025-05-30 08:00:00")


# ---------------------------------------------------------------- Bronze


_DATED = "CASE WHEN o_orderkey % 7 > 1 THEN CAST(o_orderdate AS DATE) END"


@query(
    "bronze_date_parts",
    f"SELECT o_orderkey, {_DATED} AS situation_date, CAST(year({_DATED}) AS INTEGER) AS year, "
    f"CAST(month({_DATED}) AS INTEGER) AS month, CAST(day({_DATED}) AS INTEGER) AS day FROM orders",
)
def bronze_date_parts(spark, sf_dir):
    """Whole dates, and text with a year only or without a day, which are no dates."""
    text = F.col("o_orderdate").cast("string")
    kind = F.col("o_orderkey") % 7
    short = F.when(kind == 0, F.substring(text, 1, 4)).when(kind == 1, F.substring(text, 1, 7)).otherwise(text)
    return with_day_parts(table(spark, sf_dir, "orders").select("o_orderkey", short.alias("situation_date")))


# Three snapshot days; as text, day 9 would come after day 30.
_SNAPSHOT_DAYS = {0: "2024-12-31", 1: "2025-05-9", 2: "2025-05-30"}
_SNAPSHOT_DAY_SQL = (
    "CASE o_orderkey % 3 WHEN 0 THEN DATE '2024-12-31' WHEN 1 THEN DATE '2025-05-09' ELSE DATE '2025-05-30' END"
)


def _snapshot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 3 == 0, _SNAPSHOT_DAYS[0]).when(F.col("o_orderkey") % 3 == 1, _SNAPSHOT_DAYS[1])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.withColumn("situation_date", F.concat(day.otherwise(_SNAPSHOT_DAYS[2]), F.lit(" 09:30:00")))


_SNAPSHOT_SQL = f"""
    SELECT o_orderkey, o_totalprice, {_SNAPSHOT_DAY_SQL} AS situation_date,
           CAST(year({_SNAPSHOT_DAY_SQL}) AS INTEGER) AS year, CAST(month({_SNAPSHOT_DAY_SQL}) AS INTEGER) AS month,
           CAST(day({_SNAPSHOT_DAY_SQL}) AS INTEGER) AS day
    FROM orders"""


@query("bronze_partitioned_roundtrip", _SNAPSHOT_SQL)
def bronze_partitioned_roundtrip(spark, sf_dir):
    """Written twice: the second run replaces the days of the first."""
    root = scratch_dir(spark, "bronze")
    for _ in range(2):
        write_by_situation_date(_snapshot_orders(spark, sf_dir), root)
    return days.read_days(spark, root, "all")


@query(
    "bronze_ingestion_day_roundtrip",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS card_brand, 2025 AS year, 5 AS month, d.day AS day "
    "FROM part, (SELECT 8 AS day UNION ALL SELECT 9) d",
)
def bronze_ingestion_day_roundtrip(spark, sf_dir):
    """Two ingestion days of one dataset, the second one written twice."""
    root = scratch_dir(spark, "bronze")
    cards = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("card_brand"))
    for day in (8, 9, 9):
        write_ingestion_day(cards, root, date(2025, 5, day))
    return days.read_days(spark, root, "all")


# Windows of ids: one twice, then one that overlaps it and covers the rest.
_WINDOWS = [(0, 3999), (0, 3999), (2000, 10**12)]


def _load_windows(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_dir(spark, "bronze") + "/transactions"
    for low, last in _WINDOWS:
        rows = _snapshot_orders(spark, sf_dir).where(F.col("o_orderkey").between(low, last))
        load_window(rows, root, (low, last), "o_orderkey")
    return root


@query("bronze_windows_loaded_once", _SNAPSHOT_SQL)
def bronze_windows_loaded_once(spark, sf_dir):
    """Every row once, whatever windows were loaded again."""
    return days.read_days(spark, _load_windows(spark, sf_dir), "all")


@query(
    "bronze_load_ledger",
    f"""
    WITH snapshots AS ({_SNAPSHOT_SQL}),
    loads AS (SELECT DISTINCT situation_date AS day, CASE WHEN o_orderkey < 4000 THEN 0 ELSE 2000 END AS low,
                     CASE WHEN o_orderkey < 4000 THEN 3999 ELSE 1000000000000 END AS last FROM snapshots)
    SELECT loads.day AS day, CAST(min(low) AS BIGINT) AS low, CAST(max(last) AS BIGINT) AS last, any_value(n) AS n_rows
    FROM loads JOIN (SELECT situation_date, count(*) AS n FROM snapshots GROUP BY situation_date) c ON c.situation_date = loads.day
    GROUP BY loads.day""",
)
def bronze_load_ledger(spark, sf_dir):
    """What is loaded for each day: one range, as the windows overlap, and the rows that the loads counted."""
    ledger = entries(spark, _load_windows(spark, sf_dir))
    counts = ledger.groupBy("day").agg(F.sum("n_rows").alias("n_rows"))
    return held_ranges(ledger).join(counts, "day")


# ---------------------------------------------------------------- Silver


@query("silver_latest_partition", f"SELECT * FROM ({_SNAPSHOT_SQL}) WHERE situation_date = DATE '2025-05-30'")
def silver_latest_partition(spark, sf_dir):
    root = scratch_dir(spark, "bronze")
    write_by_situation_date(_snapshot_orders(spark, sf_dir), root)
    return days.read_days(spark, root)


@query(
    "silver_latest_rows",
    f"SELECT * FROM ({_SNAPSHOT_SQL}) WHERE situation_date = "
    f"(SELECT max(situation_date) FROM ({_SNAPSHOT_SQL}))",
)
def silver_latest_rows(spark, sf_dir):
    return with_day_parts(_snapshot_orders(spark, sf_dir)).transform(days.latest_rows)


@query(
    "silver_path_date_parts",
    f"SELECT year, month, day, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS sum_id "
    f"FROM ({_SNAPSHOT_SQL}) GROUP BY ALL",
)
def silver_path_date_parts(spark, sf_dir):
    root = scratch_dir(spark, "bronze")
    write_by_situation_date(_snapshot_orders(spark, sf_dir), root)
    unpartitioned = spark.read.option("recursiveFileLookup", True).parquet(root)
    rows = days.with_path_days(unpartitioned)
    return rows.groupBy("year", "month", "day").agg(
        F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("sum_id")
    )


@query(
    "silver_money_clean",
    "SELECT l_orderkey, l_linenumber, "
    "CASE WHEN l_returnflag = 'R' THEN -l_extendedprice * 100 ELSE l_extendedprice * 100 END AS amount_cents "
    "FROM lineitem",
)
def silver_money_clean(spark, sf_dir):
    sign = F.when(F.col("l_returnflag") == "R", "$-").otherwise("$")
    text = F.concat(sign, F.format_number("l_extendedprice", 2))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("amount"))
    return lines.select("l_orderkey", "l_linenumber", (money("amount") * 100).alias("amount_cents"))


@query(
    "silver_typed_casts",
    """
    SELECT l_orderkey AS id,
           CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN NULL
                ELSE CAST(l_suppkey AS INTEGER) END AS as_int,
           CAST(CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 99999999999.0
                WHEN 3 THEN l_suppkey + 0.75 ELSE l_suppkey + 0.0 END AS DOUBLE) AS as_double,
           CASE WHEN l_linenumber NOT IN (1, 5, 6) THEN CAST(l_shipdate AS DATE) END AS as_day,
           CASE WHEN l_linenumber NOT IN (1, 5, 6) THEN l_shipdate END AS as_time
    FROM lineitem
    """,
)
def silver_typed_casts(spark, sf_dir):
    """Text that is no number, too large, fractional, padded or plain; broken, short and good dates."""
    kind, number = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    text = (
        F.when(kind == 1, F.concat(F.lit("n/a "), number))
        .when(kind == 2, "99999999999")
        .when(kind == 3, F.concat(number, F.lit(".75")))
        .when(kind == 4, F.concat(F.lit("  "), number, F.lit(" ")))
        .otherwise(number)
    )
    shipped = F.col("l_shipdate").cast("string")
    time = (
        F.when(kind == 1, "2025-02-30 00:00:00").when(kind == 5, F.substring(shipped, 1, 4))
        .when(kind == 6, F.substring(shipped, 1, 7)).otherwise(shipped)
    )
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), text.alias("text"), time.alias("time"))
    return raw.select(
        "id",
        to_int("text").alias("as_int"),
        to_double("text").alias("as_double"),
        to_day("time").alias("as_day"),
        to_timestamp("time").cast("timestamp_ntz").alias("as_time"),
    )


@query(
    "silver_flag_to_bool",
    "SELECT p_partkey AS id, CASE WHEN p_size % 5 IN (0, 2) THEN true WHEN p_size % 5 IN (1, 3) THEN false END "
    "AS has_chip, CASE WHEN p_size % 5 = 0 THEN true WHEN p_size % 5 = 1 THEN false END AS has_chip_exact FROM part",
)
def silver_flag_to_bool(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ["YES", "NO", " yes", "No", "?"])), (F.col("p_size") % 5 + 1).cast("int"))
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("raw"))
    return raw.select("id", flag("raw").alias("has_chip"), flag("raw", exact_case=True).alias("has_chip_exact"))


@query(
    "silver_gender_code",
    "SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender FROM customer",
)
def silver_gender_code(spark, sf_dir):
    return bindings.raw_users(spark, sf_dir).select("id", "gender").dropDuplicates().select(
        F.col("id").cast("bigint").alias("id"), gender_code("gender").alias("gender")
    )


@query(
    "silver_dedup",
    "SELECT DISTINCT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders)",
)
def silver_dedup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.unionByName(orders).dropDuplicates()


@query(
    "silver_transactions_clean",
    f"SELECT DISTINCT {bindings.CLEAN_TRANSACTION}, DATE '2025-05-30' AS situation_date, "
    "2025 AS year, 5 AS month, 30 AS day FROM lineitem WHERE l_orderkey % 3 = 2",
)
def silver_transactions_clean(spark, sf_dir):
    newest = with_day_parts(bindings.raw_transactions(spark, sf_dir)).transform(days.latest_rows)
    return CLEANERS["transactions"](newest).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("silver_cards_clean", bindings.CLEAN_CARDS)
def silver_cards_clean(spark, sf_dir):
    return CLEANERS["cards"](bindings.raw_cards(spark, sf_dir))


@query("silver_users_clean", bindings.CLEAN_USERS)
def silver_users_clean(spark, sf_dir):
    return CLEANERS["users"](bindings.raw_users(spark, sf_dir))


@query("silver_mcc_clean", bindings.CLEAN_MCC_CODES)
def silver_mcc_clean(spark, sf_dir):
    return CLEANERS["mcc_codes"](bindings.raw_mcc_codes(spark, sf_dir))


@query("silver_labels_clean", bindings.CLEAN_LABELS)
def silver_labels_clean(spark, sf_dir):
    return CLEANERS["train_fraud_labels"](bindings.raw_labels(spark, sf_dir))


@query(
    "silver_label_conflicts",
    with_typed("fraud_labels")
    + "SELECT id, count(*) AS n_rows, count(DISTINCT label) AS n_labels, min(label) AS first_label "
    "FROM fraud_labels GROUP BY id HAVING count(DISTINCT label) > 1",
)
def silver_label_conflicts(spark, sf_dir):
    return quality.label_conflicts(typed(spark, sf_dir, "fraud_labels"))


@query(
    "silver_table_roundtrip",
    f"SELECT *, 2025 AS year, 5 AS month, 9 AS day FROM ({bindings.CLEAN_CARDS})",
)
def silver_table_roundtrip(spark, sf_dir):
    """Bronze folder to catalog table."""
    root = scratch_dir(spark, "lake")
    write_ingestion_day(bindings.raw_cards(spark, sf_dir), f"{root}/bronze/cards", date(2025, 5, 9))
    return _through_catalog(
        spark, root, "cards",
        lambda database: silver.refresh_entity(spark, f"{root}/bronze", f"{root}/silver", "cards", database=database),
    )


@query(
    "ops_layer_counts",
    f"""
    SELECT 'bronze' AS layer, 'transactions' AS entity,
           count(*) + count(CASE WHEN l_linenumber = 4 THEN 1 END) AS n_rows FROM lineitem
    UNION ALL SELECT 'bronze', 'cards', count(*) + count(CASE WHEN p_partkey % 5 = 0 THEN 1 END) FROM part
    UNION ALL SELECT 'bronze', 'users', count(*) + count(CASE WHEN c_custkey % 3 = 0 THEN 1 END) FROM customer
    UNION ALL SELECT 'bronze', 'mcc_codes', count(*) + count(CASE WHEN s_suppkey % 4 = 0 THEN 1 END) FROM supplier
    UNION ALL SELECT 'bronze', 'train_fraud_labels', count(*) + count(CASE WHEN id % 3 = 0 THEN 1 END)
              FROM ({bindings.CLEAN_LABELS})
    UNION ALL SELECT 'silver', 'transactions', count(*) FROM (
              SELECT DISTINCT {bindings.CLEAN_TRANSACTION}, l_orderkey % 3 AS situation FROM lineitem)
    UNION ALL SELECT 'silver', 'cards', count(*) FROM part
    UNION ALL SELECT 'silver', 'users', count(*) FROM customer
    UNION ALL SELECT 'silver', 'mcc_codes', count(*) FROM supplier
    UNION ALL SELECT 'silver', 'train_fraud_labels', count(*) FROM ({bindings.CLEAN_LABELS})
    """,
)
def ops_layer_counts(spark, sf_dir):
    layers = {}
    for entity, raw in RAW.items():
        rows = raw(spark, sf_dir)
        layers["bronze", entity] = rows
        layers["silver", entity] = CLEANERS[entity](rows)
    return quality.layer_counts(layers)


@query(
    "ops_duplicate_codes",
    "SELECT mcc_code, count(*) AS n_rows FROM (SELECT c_nationkey AS mcc_code FROM customer) GROUP BY 1 HAVING count(*) > 1",
)
def ops_duplicate_codes(spark, sf_dir):
    return quality.duplicate_codes(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mcc_code")))


@query("ops_undated", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <= 1")
def ops_undated(spark, sf_dir):
    """Orders whose date text has a year only, or no day."""
    text = F.col("o_orderdate").cast("string")
    kind = F.col("o_orderkey") % 7
    short = F.when(kind == 0, F.substring(text, 1, 4)).when(kind == 1, F.substring(text, 1, 7)).otherwise(text)
    dated = table(spark, sf_dir, "orders").select("o_orderkey", short.alias("situation_date"))
    return quality.undated(dated).select("o_orderkey")


# ---------------------------------------------------------------- Gold

_LABELLED = with_typed("transactions", "fraud_labels") + ", labelled AS (SELECT t.*, label, " \
    "CASE WHEN label IN ('Yes', '1') THEN 1 ELSE 0 END AS is_fraud " \
    "FROM transactions t LEFT JOIN fraud_labels USING (id)) "

_FRAUD_MART = "SELECT merchant_city, is_fraud, count(*) AS nb_transactions FROM labelled GROUP BY ALL"
_REGION_MART = (
    "SELECT merchant_state, CAST(sum(CAST(amount_usd AS DECIMAL(30, 6))) AS DOUBLE) AS total_usd "
    "FROM {facts} GROUP BY merchant_state"
)
_CATEGORY_MART = (
    "SELECT description, count(*) AS nb_trans FROM {facts} LEFT JOIN mcc_codes ON mcc = mcc_code GROUP BY description"
)
_CLIENT_MART = (
    "SELECT u.id AS user_id, gender, credit_limit_usd, num_credit_cards FROM users u JOIN cards c ON u.id = c.client_id"
)
_CARD_MART = "SELECT card_brand, card_type, count(*) AS nb_cartes FROM cards GROUP BY ALL"


def _fraud_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.dm_fraude_detection(_labelled(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.label_transactions(typed(spark, sf_dir, "transactions"), typed(spark, sf_dir, "fraud_labels"))


def _region_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.dm_transactions_par_region(marts.per_state_and_code(typed(spark, sf_dir, "transactions")))


def _client_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.dm_clients(typed(spark, sf_dir, "users"), typed(spark, sf_dir, "cards"))


def _card_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.dm_cartes(typed(spark, sf_dir, "cards"))


def _category_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = marts.per_state_and_code(typed(spark, sf_dir, "transactions"))
    return marts.dm_mcc_categories(rolled, typed(spark, sf_dir, "mcc_codes"))


def _marts_per_label(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    entities = ("transactions", "fraud_labels", "users", "cards", "mcc_codes")
    return gold.build_marts(*(typed(spark, sf_dir, name) for name in entities), count_per_label=True)


@query(
    "gold_transactions_labeled",
    _LABELLED + "SELECT id, line, merchant_city, amount_usd, label, is_fraud FROM labelled",
)
def gold_transactions_labeled(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", "line", "merchant_city", "amount_usd", "label", "is_fraud")


@query("gold_dm_fraude_detection", _LABELLED + _FRAUD_MART)
def gold_dm_fraude_detection(spark, sf_dir):
    return _fraud_mart(spark, sf_dir)


@query("gold_dm_clients", with_typed("users", "cards") + _CLIENT_MART)
def gold_dm_clients(spark, sf_dir):
    return _client_mart(spark, sf_dir)


@query("gold_dm_transactions_par_region", with_typed("transactions") + _REGION_MART.format(facts="transactions"))
def gold_dm_transactions_par_region(spark, sf_dir):
    return _region_mart(spark, sf_dir)


_DISCOUNT = "CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_discount AS DECIMAL(18, 2))"


@query(
    "gold_region_mart_of_small_amounts",
    f"SELECT l_returnflag AS merchant_state, CAST(sum({_DISCOUNT}) AS DOUBLE) AS total_usd FROM lineitem GROUP BY 1",
)
def gold_region_mart_of_small_amounts(spark, sf_dir):
    """Amounts with four decimals: prices times discounts."""
    amount = F.expr(_DISCOUNT).cast("double").alias("amount_usd")
    lines = table(spark, sf_dir, "lineitem")
    facts = lines.select(F.col("l_returnflag").alias("merchant_state"), F.col("l_suppkey").alias("mcc"), amount)
    return marts.dm_transactions_par_region(marts.per_state_and_code(facts))


@query("gold_dm_region_per_label", _LABELLED + _REGION_MART.format(facts="labelled"))
def gold_dm_region_per_label(spark, sf_dir):
    return _marts_per_label(spark, sf_dir)["dm_transactions_par_region"]


@query("gold_dm_cartes", with_typed("cards") + _CARD_MART)
def gold_dm_cartes(spark, sf_dir):
    return _card_mart(spark, sf_dir)


@query("gold_dm_mcc_categories", with_typed("transactions", "mcc_codes") + _CATEGORY_MART.format(facts="transactions"))
def gold_dm_mcc_categories(spark, sf_dir):
    return _category_mart(spark, sf_dir)


@query(
    "gold_dm_categories_per_label",
    _LABELLED + f", mcc_codes AS ({bindings.TYPED['mcc_codes']}) " + _CATEGORY_MART.format(facts="labelled"),
)
def gold_dm_categories_per_label(spark, sf_dir):
    return _marts_per_label(spark, sf_dir)["dm_mcc_categories"]


@query(
    "gold_fraud_mart_from_bronze",
    f"""
    WITH transactions AS (SELECT DISTINCT {bindings.CLEAN_TRANSACTION} FROM lineitem WHERE l_orderkey % 3 = 2),
    labelled AS (
        SELECT t.*, CASE WHEN label IN ('Yes', '1') THEN 1 ELSE 0 END AS is_fraud
        FROM transactions t LEFT JOIN ({bindings.CLEAN_LABELS}) l ON t.id = l.id)
    """ + _FRAUD_MART,
)
def gold_fraud_mart_from_bronze(spark, sf_dir):
    """Raw text through the Bronze folders and the Silver and Gold tables."""
    root = scratch_dir(spark, "lake")
    write_by_situation_date(bindings.raw_transactions(spark, sf_dir), f"{root}/bronze/transactions")
    for entity in ("cards", "users", "mcc_codes", "train_fraud_labels"):
        write_ingestion_day(RAW[entity](spark, sf_dir), f"{root}/bronze/{entity}", date(2025, 5, 30))

    def refresh(database: str) -> None:
        silver.refresh_silver(spark, f"{root}/bronze", f"{root}/silver", database=database)
        gold.refresh_gold(spark, f"{root}/gold", f"{root}/silver", database=database)

    return _through_catalog(spark, root, "dm_fraude_detection", refresh)


_ADHOC = (
    "SELECT card_brand, sum(nb_cartes) AS nb, max(card_type) AS last_type, "
    "concat('say \"', max(card_type), '\", ok') AS quoted FROM dm_cartes GROUP BY card_brand"
)
_ADHOC_ORACLE = (
    with_typed("cards") + f", dm_cartes AS ({_CARD_MART}) "
    "SELECT card_brand, CAST(sum(nb_cartes) AS BIGINT) AS nb, max(card_type) AS last_type, "
    "'say \"' || max(card_type) || '\", ok' AS quoted FROM dm_cartes GROUP BY card_brand"
)


@query("gold_sql_adhoc", _ADHOC_ORACLE)
def gold_sql_adhoc(spark, sf_dir):
    adhoc.register_marts({"dm_cartes": _card_mart(spark, sf_dir)})
    return adhoc.run_query(spark, _ADHOC + " ORDER BY nb DESC;")


@query("gold_sql_csv_export", _ADHOC_ORACLE)
def gold_sql_csv_export(spark, sf_dir):
    """The export, read back with the types of the result."""
    adhoc.register_marts({"dm_cartes": _card_mart(spark, sf_dir)})
    return adhoc.run_and_export(spark, _ADHOC, scratch_dir(spark, "export"))[0]


# ---------------------------------------------------------------- reports


@query(
    "report_state_totals",
    with_typed("transactions")
    + f"SELECT * FROM ({_REGION_MART.format(facts='transactions')}) WHERE merchant_state IS NOT NULL",
)
def report_state_totals(spark, sf_dir):
    return reports.state_totals(_region_mart(spark, sf_dir))


@query(
    "report_top_cities",
    _LABELLED + "SELECT merchant_city, count(*) AS nb_transactions FROM labelled GROUP BY merchant_city "
    "ORDER BY nb_transactions DESC, merchant_city LIMIT 10",
)
def report_top_cities(spark, sf_dir):
    return reports.top_cities(_fraud_mart(spark, sf_dir), 10)


@query(
    "report_online_segment",
    _LABELLED + "SELECT CASE WHEN merchant_city = 'ONLINE' THEN 'ONLINE' ELSE 'PHYSICAL' END AS segment, "
    "count(*) AS nb_transactions, CAST(sum(is_fraud) AS BIGINT) AS nb_frauds FROM labelled GROUP BY 1",
)
def report_online_segment(spark, sf_dir):
    return reports.online_segment(_fraud_mart(spark, sf_dir))


@query(
    "report_credit_by_gender",
    with_typed("users", "cards") + "SELECT gender, count(*) AS nb_cards, "
    "CAST(sum(CAST(credit_limit_usd AS DECIMAL(30, 6))) AS DOUBLE) AS credit_limit_usd "
    f"FROM ({_CLIENT_MART}) GROUP BY gender",
)
def report_credit_by_gender(spark, sf_dir):
    return reports.credit_by_gender(_client_mart(spark, sf_dir))


@query(
    "report_top_categories",
    with_typed("transactions", "mcc_codes")
    + f"SELECT * FROM ({_CATEGORY_MART.format(facts='transactions')}) WHERE description IS NOT NULL "
    "ORDER BY nb_trans DESC, description LIMIT 10",
)
def report_top_categories(spark, sf_dir):
    return reports.top_categories(_category_mart(spark, sf_dir), 10)


@query(
    "report_card_mix",
    with_typed("cards") + "SELECT 'brand' AS dimension, card_brand AS value, count(*) AS nb_cartes FROM cards "
    "GROUP BY card_brand UNION ALL SELECT 'type', card_type, count(*) FROM cards GROUP BY card_type",
)
def report_card_mix(spark, sf_dir):
    return reports.card_mix(_card_mart(spark, sf_dir))


# ---------------------------------------------------------------- fraud model

_BASE = with_typed("transactions", "fraud_labels", "cards", "mcc_groups") + """, base AS (
    SELECT t.id, line, amount_usd, credit_limit_usd, merchant_state, card_brand, card_type,
           CAST(has_chip AS INTEGER) AS has_chip, description,
           CASE WHEN label IN ('Yes', '1') THEN 1 ELSE 0 END AS fraud_label
    FROM transactions t JOIN fraud_labels l ON t.id = l.id
    LEFT JOIN cards c ON t.card_id = c.id LEFT JOIN mcc_groups m ON t.mcc = m.mcc_code) """
_SAMPLE = _BASE + (
    f", sample AS (SELECT * FROM base WHERE fraud_label = 1 OR {_md5_bucket('id', 10, 'sample-42')} = 0) "
)
_BASE_COLUMNS = [
    "id", "line", "amount_usd", "credit_limit_usd", "merchant_state", "card_brand", "card_type", "has_chip",
    "description", "fraud_label",
]


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    transactions, labels, cards, groups = _model_entities(spark, sf_dir)
    return joins.feature_base(transactions, joins.flag_labels(labels), cards, groups).select(*_BASE_COLUMNS)


def _model_entities(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [typed(spark, sf_dir, name) for name in ("transactions", "fraud_labels", "cards", "mcc_groups")]


@query(
    "ml_label_semi_join",
    with_typed("transactions", "fraud_labels")
    + "SELECT id, line, amount_usd FROM transactions WHERE id IN (SELECT id FROM fraud_labels)",
)
def ml_label_semi_join(spark, sf_dir):
    kept = joins.keep_labelled(typed(spark, sf_dir, "transactions"), typed(spark, sf_dir, "fraud_labels"))
    return kept.select("id", "line", "amount_usd")


@query("ml_labeled_base", _BASE + "SELECT * FROM base")
def ml_labeled_base(spark, sf_dir):
    return _base(spark, sf_dir)


@query("ml_class_balance", _BASE + "SELECT fraud_label, count(*) AS n_rows FROM base GROUP BY fraud_label")
def ml_class_balance(spark, sf_dir):
    flagged = joins.flag_labels(typed(spark, sf_dir, "fraud_labels"))
    labelled = joins.labelled_base(typed(spark, sf_dir, "transactions"), flagged)
    return sampling.class_balance(labelled)


@query("ml_balanced_sample", _SAMPLE + "SELECT * FROM sample")
def ml_balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(_base(spark, sf_dir))


@query(
    "ml_train_test_split",
    _SAMPLE + f"SELECT *, CASE WHEN {_md5_bucket('id', 100, 'split-42')} < 80 THEN 'train' ELSE 'test' END AS split "
    "FROM sample",
)
def ml_train_test_split(spark, sf_dir):
    return sampling.with_split(sampling.balanced_sample(_base(spark, sf_dir)))


def _index_sql(source: str) -> str:
    """Values of every categorical column with their index by falling frequency."""
    parts = [
        f"SELECT '{name}' AS name, CAST({name} AS VARCHAR) AS value, count(*) AS n_rows FROM {source} GROUP BY ALL"
        for name in fraud.CATEGORICAL
    ]
    return (
        "SELECT name, value, n_rows, CAST(CASE WHEN value IS NULL THEN count(value) OVER (PARTITION BY name) ELSE "
        "row_number() OVER (PARTITION BY name ORDER BY value IS NULL, n_rows DESC, value) - 1 END AS DOUBLE) AS idx "
        f"FROM ({' UNION ALL '.join(parts)})"
    )


@query("ml_string_index", _BASE + _index_sql("base"))
def ml_string_index(spark, sf_dir):
    base = stored(_base(spark, sf_dir), "base")
    indexed = indexing.with_indexes(base, stored(indexing.category_index(base, fraud.CATEGORICAL), "index"), fraud.CATEGORICAL)
    pairs = [
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), F.col(f"{c}_idx").alias("idx"))
        for c in fraud.CATEGORICAL
    ]
    rows = indexed.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*")
    return rows.groupBy("name", "value", "idx").agg(F.count("*").alias("n_rows"))


# As many values of a column as have an index of their own, in the folded index.
_FOLD = 3


@query(
    "ml_folded_index",
    _BASE + f", indexes AS ({_index_sql('base')}) SELECT name, least(idx, {_FOLD}) AS idx, CAST(sum(n_rows) AS BIGINT) AS n_rows "
    f"FROM (SELECT name, n_rows, CASE WHEN value IS NULL THEN {_FOLD} ELSE idx END AS idx FROM indexes) GROUP BY ALL",
)
def ml_folded_index(spark, sf_dir):
    """Rows of every index where rare, unseen and missing values share one; a column of few values has a smaller one."""
    base = stored(_base(spark, sf_dir), "base")
    index = stored(indexing.category_index(base, fraud.CATEGORICAL, _FOLD), "index")
    indexed = indexing.with_indexes(base, index, fraud.CATEGORICAL)
    # Of a column with fewer values the next free index is below _FOLD.
    own = [F.when(F.col(c).isNull(), float(_FOLD)).otherwise(F.col(f"{c}_idx")) for c in fraud.CATEGORICAL]
    pairs = [F.struct(F.lit(c).alias("name"), idx.alias("idx")) for c, idx in zip(fraud.CATEGORICAL, own)]
    rows = indexed.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*")
    return rows.groupBy("name", "idx").agg(F.count("*").alias("n_rows"))


@query(
    "ml_feature_matrix",
    _SAMPLE + f", indexes AS ({_index_sql('sample')}) SELECT s.id, s.fraud_label, amount_usd, credit_limit_usd, "
    + ", ".join(
        f"(SELECT idx FROM indexes WHERE name = '{c}' AND value IS NOT DISTINCT FROM CAST(s.{c} AS VARCHAR)) AS {c}_idx"
        for c in fraud.CATEGORICAL
    )
    + " FROM sample s",
)
def ml_feature_matrix(spark, sf_dir):
    sample = stored(fraud.training_rows(*_model_entities(spark, sf_dir)), "training")
    features = fraud.assembler().transform(fraud.fit_indexers(sample).transform(sample))
    vector = features.select("id", "fraud_label", vector_to_array("features").alias("x"))
    named = [F.col("x")[i].alias(name) for i, name in enumerate(fraud.FEATURES)]
    return vector.select("id", "fraud_label", *named)


# A class that one feature decides, so that the prediction is known: whether the card has a chip.
_CHIP_TEST = _SAMPLE + (
    ", test AS (SELECT id, amount_usd, credit_limit_usd, merchant_state, card_brand, card_type, has_chip, description "
    f"FROM sample WHERE {_md5_bucket('id', 100, 'split-42')} >= 80) "
)


def _chip_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Train and test part, with the chip as the class."""
    parts = fraud.prepare_training(*_model_entities(spark, sf_dir))
    return [part.withColumn("fraud_label", F.col("has_chip")) for part in parts]


@query("ml_gbt_score", _CHIP_TEST + "SELECT id, amount_usd, has_chip, CAST(has_chip AS DOUBLE) AS prediction FROM test")
def ml_gbt_score(spark, sf_dir):
    """Predictions for the test part by a model trained on the train part."""
    training, test = _chip_parts(spark, sf_dir)
    return fraud.score(fraud.train(training, max_iter=2), test).select("id", "amount_usd", "has_chip", "prediction")


@query(
    "ml_saved_model_score",
    _CHIP_TEST + "SELECT amount_usd, credit_limit_usd, merchant_state, card_brand, card_type, "
    "CAST(has_chip AS VARCHAR) AS has_chip, description, CAST(has_chip AS DOUBLE) AS prediction FROM test",
)
def ml_saved_model_score(spark, sf_dir):
    """A model saved and loaded, on rows of the declared schema."""
    training, test = _chip_parts(spark, sf_dir)
    path = scratch_dir(spark, "model")
    fraud.save(fraud.train(training, max_iter=2), path)
    declared = [part.strip().split(" ") for part in SCORING_INPUT.split(",")]
    rows = test.select(*(F.col(name).cast(kind).alias(name) for name, kind in declared))
    scored = fraud.score(fraud.load(path), fraud.check_inputs(rows))
    return scored.select(*rows.columns, "prediction")


@query(
    "ml_missing_features",
    _SAMPLE + ", holes AS (SELECT amount_usd, CASE WHEN id % 5 > 0 THEN credit_limit_usd END AS credit_limit_usd FROM sample) "
    "SELECT count(*) - count(amount_usd) AS n_without_amount_usd, "
    "count(*) - count(credit_limit_usd) AS n_without_credit_limit_usd, count(*) AS n_rows FROM holes",
)
def ml_missing_features(spark, sf_dir):
    """Rows that training would leave out, with every fifth credit limit missing."""
    rows = fraud.training_rows(*_model_entities(spark, sf_dir))
    return fraud.missing_features(rows.withColumn("credit_limit_usd", F.when(F.col("id") % 5 > 0, F.col("credit_limit_usd"))))


@query(
    "ml_auc",
    _BASE + """
    , ranked AS (
        SELECT fraud_label, rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0 AS r
        FROM (SELECT fraud_label, round(amount_usd, -2) AS amount FROM base))
    SELECT round((sum(CASE WHEN fraud_label = 1 THEN r END) - p * (p + 1) / 2.0) / (p * n), 9) AS auc
    FROM ranked, (SELECT CAST(sum(fraud_label) AS DOUBLE) AS p, CAST(sum(1 - fraud_label) AS DOUBLE) AS n FROM base)
    GROUP BY p, n
    """,
)
def ml_auc(spark, sf_dir):
    """Area under the curve of a score with many ties: the amount in hundreds."""
    scored = _base(spark, sf_dir).select("fraud_label", F.round("amount_usd", -2).alias("score"))
    auc = fraud.area_under_roc(scored, "score")
    return spark.createDataFrame([(auc,)], "auc double").select(F.round("auc", 9).alias("auc"))
