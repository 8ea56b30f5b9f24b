import json
from unittest import mock

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from cardlake.functions.dates import with_day_parts
from cardlake.sinks import exports
from cardlake.sources import days, files, relational, snapshots
from registry.queries import _rows_per_range


def test_csv_is_text_without_a_schema(spark, tmp_path):
    path = tmp_path / "cards.csv"
    path.write_text('id,card_brand,credit_limit\n01,Visa,"$1,200"\n2,,$5\n')
    df = files.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "string", "card_brand": "string", "credit_limit": "string"}
    assert [tuple(r) for r in df.collect()] == [("01", "Visa", "$1,200"), ("2", None, "$5")]


def test_csv_with_declared_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,zip\n1,58523.0\n2,x\n")
    with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE|Malformed"):
        files.read_csv(spark, str(path), "id int, zip double").collect()
    path.write_text("id,zip\n1,58523.0\n2,\n")
    assert [tuple(r) for r in files.read_csv(spark, str(path), "id int, zip double").collect()] == [
        (1, 58523.0),
        (2, None),
    ]
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(path), "zip double, id int").collect()


def test_csv_quotes_commas_and_line_breaks(spark, tmp_path, rows):
    values = [("he said \"hi\", ok", 1), ("two\nlines", 2), ("", 3), ("back\\slash", 4)]
    path = exports.export_csv(spark.createDataFrame(values, "v string, n int"), str(tmp_path))
    expected = [(v or None, n) for v, n in values]  # an empty cell is null
    assert rows(files.read_csv(spark, path, "v string, n int", multiline=True)) == sorted(expected, key=repr)


def test_code_map_last_value_of_a_repeated_key_counts(spark, tmp_path, rows):
    path = tmp_path / "mcc.json"
    path.write_text('{"5812": "Eating Places", "x1": "odd key",\n "5411": "a, \\"b\\"", "5812": "Restaurants"}')
    expected = json.loads(path.read_text())
    assert rows(files.read_json(spark, "mcc_codes", str(path))) == sorted(expected.items())


def test_map_column_keeps_the_key_of_its_row(spark, rows):
    df = spark.createDataFrame([(1, '{"a": "x", "b": null, "a": "y"}'), (2, "{}"), (4, None)], "id int, j string")
    assert rows(files.explode_json_map(df, "j", "k", "v", keep=("id",))) == [(1, "a", "y"), (1, "b", None)]


@pytest.mark.parametrize("text", ['{"5812": "Eating Places", "54', "broken", '["a"]'])
def test_a_cut_off_code_list_fails(spark, tmp_path, text):
    path = tmp_path / "mcc.json"
    path.write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_code_map(spark, str(path)).collect()


RECORDS = '{"id": "1", "label": "Yes"}\n{"id": 2, "label": "No"}\n{"id": "1", "label": "No"}\n'
OBJECT = '{"target": {"1": "Yes",\n "2":"No" , "1" : "No"}}'


ARRAY = "[" + ",".join(RECORDS.split("\n")[:-1]) + "]"
PRETTY = json.dumps(json.loads(ARRAY), indent=2)


@pytest.mark.parametrize(
    ("shape", "text"),
    [("records", RECORDS), ("records", ARRAY), ("array", ARRAY), ("array", PRETTY), ("pairs", OBJECT), ("pairs", OBJECT[11:-1]),
     ("pairs", OBJECT.replace("target", "label"))],
)
def test_labels_in_every_shape(spark, tmp_path, rows, shape, text):
    path = tmp_path / "labels.json"
    path.write_text(text)
    expected = [("1", "No"), ("1", "Yes"), ("2", "No")]
    assert rows(files.read_json(spark, "train_fraud_labels", str(path), shape=shape)) == expected


@pytest.mark.parametrize(
    ("shape", "text"),
    [("records", OBJECT), ("records", PRETTY), ("records", RECORDS[:-15]), ("array", OBJECT), ("array", PRETTY[:-20]), ("pairs", RECORDS),
     ("pairs", ARRAY), ("pairs", OBJECT[:-12])],
)
def test_another_shape_or_a_cut_off_file_fails(spark, tmp_path, shape, text):
    path = tmp_path / "labels.json"
    path.write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|not an id/label pair|not a label record"):
        files.read_labels(spark, str(path), shape).collect()


def test_a_folder_of_both_shapes_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text(RECORDS)
    (tmp_path / "b.json").write_text(OBJECT.replace("\n", " "))
    for shape in ("records", "pairs"):
        with pytest.raises(Exception, match="(?i)malformed|not an id/label pair|not a label record"):
            files.read_labels(spark, str(tmp_path), shape).collect()
    with pytest.raises(ValueError, match="unknown label file shape"):
        files.read_labels(spark, str(tmp_path), "guess")


def test_large_label_object_is_split_over_tasks(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"target": {str(i): "Yes" if i % 50 == 0 else "No" for i in range(200_000)}}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = files.read_labels(spark, str(path), "pairs")
        assert df.rdd.getNumPartitions() > 4
        assert df.distinct().count() == 200_000
        assert df.where("label = 'Yes'").count() == 4_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_label_object_with_other_text_fails(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text('{"target": {"1": "Yes", "2": {"nested": "No"}, "3": 4}}')
    with pytest.raises(Exception, match="not an id/label pair"):
        files.read_labels(spark, str(path), "pairs").collect()


def test_unknown_json_name_is_refused(spark):
    with pytest.raises(ValueError, match="unknown JSON dataset"):
        files.read_json(spark, "other", "/nowhere")


def test_id_ranges_by_width_and_by_number():
    assert relational.id_ranges(6, 25, 3)[0] == (6, 9) and relational.id_ranges(6, 25, 3)[-1] == (24, 27)
    ranges = relational.id_ranges(5, 105, count=7)
    assert len(ranges) == 7 and ranges[0][0] == 5 and ranges[-1][1] >= 105
    assert {high - low for low, high in ranges} == {15}
    for wrong in ({"size": 0}, {"count": 0}):
        with pytest.raises(ValueError):
            relational.id_ranges(0, 10, **wrong)
    with pytest.raises(ValueError, match="no id ranges"):
        relational.range_predicates([])


@pytest.mark.parametrize("ids", [[-1, 0, 9, 10, 19, 20, 29, 30, None], [5], [None, None], [-57, 88], [12, 13]])
def test_a_window_and_its_outside_read_each_row_once(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id int")
    df.createOrReplaceTempView("some_ids")
    bounds = relational.view_bounds(spark, "some_ids")
    inside = relational.id_ranges(0, 25, 10)
    ranges = sorted(inside + relational.outside_ranges(bounds, inside))
    assert all(high - low <= 10 for low, high in ranges)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    hits = [df.where(p).count() for p in relational.range_predicates(ranges, missing=bounds.missing > 0)]
    assert sum(hits) == len(ids)
    inner = relational.range_predicates(inside)
    assert sum(df.where(p).count() for p in inner) == sum(i is not None and 0 <= i < 30 for i in ids)


def fake_reader(spark, table, calls):
    """Stands in for the database: subqueries are answered from ``table``, scans by its predicates."""

    def read(reader, url, table, predicates=None, properties=None):
        calls.append((table, predicates))
        rows.createOrReplaceTempView("transactions")
        if predicates is None:
            return spark.sql(f"SELECT * FROM {table}")
        return rows.where(" OR ".join(f"({p})" for p in predicates))

    rows = table
    return mock.patch.object(DataFrameReader, "jdbc", read)


def test_by_default_the_database_says_which_ids_there_are(spark, rows):
    table = spark.createDataFrame([(i,) for i in (-7, 3, 12, 99, None)], "id int")
    calls = []
    with fake_reader(spark, table, calls):
        read = relational.read_jdbc_ranges(spark, "jdbc:x", "transactions", {}, size=20)
    assert rows(read) == rows(table)
    _, predicates = calls[-1]
    assert len(predicates) == 7 and predicates[-1] == "id IS NULL"
    with fake_reader(spark, table.where("id > 1000"), calls):
        assert relational.read_jdbc_ranges(spark, "jdbc:x", "transactions", {}).count() == 0
    with fake_reader(spark, table, calls):
        inside = relational.id_ranges(0, 20, 10)
        assert relational.read_jdbc_ranges(spark, "jdbc:x", "transactions", {}, inside, everything=True).count() == 5
        assert relational.jdbc_rows_outside(spark, "jdbc:x", "transactions", {}, inside) == 3
        with pytest.raises(ValueError, match="no id ranges"):
            relational.read_jdbc_ranges(spark, "jdbc:x", "transactions", {}, [])


def test_jdbc_scan_is_one_read_with_a_partition_per_range(spark):
    with mock.patch.object(DataFrameReader, "jdbc") as jdbc:
        relational.read_jdbc_ranges(
            spark, "jdbc:x", "transactions", {"user": "u"}, ranges=relational.id_ranges(0, 20, 10)
        )
    jdbc.assert_called_once_with(
        url="jdbc:x",
        table="transactions",
        predicates=["id >= 0 AND id < 10", "id >= 10 AND id < 20"],
        properties={"fetchsize": "10000", "user": "u"},
    )


def test_range_counts_show_empty_ranges_and_uncovered_rows(spark, rows):
    df = spark.createDataFrame([(i,) for i in [5, 12, 13, 40, None, -2]], "id int")
    assert rows(relational.range_counts(df, "id", 0, 25, 10)) == sorted(
        [
            ("in range", 0, 1, 5, 5, False),
            ("in range", 10, 2, 12, 13, False),
            ("in range", 20, 0, None, None, True),
            ("above", None, 1, 40, 40, False),
            ("below", None, 1, -2, -2, False),
            ("missing", None, 1, None, None, False),
        ],
        key=repr,
    )


def test_range_counts_read_their_input_once(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/t")
    counts = relational.range_counts(spark.read.parquet(f"{tmp_path}/t"), "id", 0, 25, 10)
    assert counts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def lake_with_days(spark, root):
    for folder, n in (
        ("year=2025/month=5/day=9", 1),
        ("year=2025/month=05/day=30", 2),
        ("year=2024/month=12/day=31", 3),
        ("year=__HIVE_DEFAULT_PARTITION__/month=__HIVE_DEFAULT_PARTITION__/day=__HIVE_DEFAULT_PARTITION__", 4),
    ):
        spark.range(n).write.parquet(f"{root}/{folder}")
    (root / "year=2026").write_text("a plain file")
    (root / "other=2030" / "month=1" / "day=1").mkdir(parents=True)
    (root / "year=2027" / "notes").mkdir(parents=True)


def test_newest_day_by_number(spark, tmp_path):
    root = tmp_path / "bronze"
    lake_with_days(spark, root)
    assert days.newest_day(spark, str(root)) == (2025, 5, 30)
    newest = days.read_days(spark, str(root))
    assert {tuple(r) for r in newest.collect()} == {(0, 2025, 5, 30), (1, 2025, 5, 30)}


def test_only_the_newest_folder_is_read(spark, tmp_path):
    root = tmp_path / "bronze"
    lake_with_days(spark, root)
    assert all("day=30" in name for name in days.read_days(spark, str(root)).inputFiles())


def test_all_days_and_two_folders_of_one_day(spark, tmp_path):
    root = tmp_path / "bronze"
    spark.range(2).write.parquet(f"{root}/year=2025/month=5/day=9")
    spark.range(3).write.parquet(f"{root}/year=2025/month=05/day=09")
    spark.range(4).write.parquet(f"{root}/year=2024/month=05/day=09")
    assert days.read_days(spark, str(root)).count() == 5
    assert days.read_days(spark, str(root), "all").count() == 9
    with pytest.raises(ValueError):
        days.read_days(spark, str(root), "some")


def test_missing_days_raise(spark, tmp_path):
    assert days.newest_day(spark, str(tmp_path)) is None
    with pytest.raises(FileNotFoundError):
        days.read_days(spark, str(tmp_path))


def test_latest_rows_of_a_frame(spark, rows):
    df = spark.createDataFrame([(1, "2025-05-9"), (2, "2025-05-30"), (3, "2024-12-31"), (4, None)], "id int, situation_date string")
    assert rows(with_day_parts(df).transform(days.latest_rows), "id") == [(2,)]


def test_latest_rows_prunes_partitions(spark, tmp_path):
    for day in (1, 2, 30):
        spark.range(day).write.parquet(f"{tmp_path}/year=2025/month=1/day={day}")
    newest = days.latest_rows(spark.read.parquet(str(tmp_path)))
    assert newest.count() == 30
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<>" in plan


def test_path_days_need_no_partition_discovery(spark, tmp_path, rows):
    spark.range(1).write.parquet(f"{tmp_path}/year=2025/month=05/day=09")
    df = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path))
    assert "year" not in df.columns
    assert rows(days.with_path_days(df)) == [(0, 2025, 5, 9)]


def test_half_snapshot_is_exact_and_stable(spark):
    df = spark.range(30_001).select(F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("id"), F.col("id").alias("row"))
    half = snapshots.half_snapshot(df)
    assert half.count() == 15_000
    assert half.exceptAll(snapshots.half_snapshot(df.repartition(5))).isEmpty()
    assert half.exceptAll(df).isEmpty()
    assert abs(half.where("id = 7").count() - 5_000) < 300


@pytest.mark.parametrize("copies", [0, 9_999, 20_000])
def test_half_snapshot_of_many_copies(spark, copies):
    df = spark.range(30_000).select(F.when(F.col("id") < copies, -1).otherwise(F.col("id")).alias("id"), F.lit(None).cast("string").alias("x"))
    half = snapshots.half_snapshot(df)
    assert half.columns == df.columns
    assert half.count() == 15_000
    assert half.exceptAll(df).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_half_snapshot_of_few_rows(spark, n):
    assert snapshots.half_snapshot(spark.range(n)).count() == n // 2


def test_first_rows_takes_copies_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(snapshots, "_BLOCK", 10)
    tied = spark.createDataFrame([("a", None)] * 3 + [("b", 1)] * 45 + [("c", 1)] * 5, "k string, v int")
    for n, expected in ((2, (2, 0, 0)), (3, (3, 0, 0)), (40, (3, 37, 0)), (50, (3, 45, 2)), (53, (3, 45, 5))):
        taken = snapshots._first_rows(tied, n).groupBy("k").count().collect()
        found = {row["k"]: row["count"] for row in taken}
        assert tuple(found.get(k, 0) for k in "abc") == expected


def test_stacked_snapshots(spark, rows):
    df = spark.range(1000)
    stacked = snapshots.stack_snapshots(df, "2025-05-29 08:00:00", "2025-05-30 08:00:00")
    per_day = {r["situation_date"]: r["count"] for r in stacked.groupBy("situation_date").count().collect()}
    assert per_day["2025-05-30 08:00:00"] == 1000
    assert per_day["2025-05-29 08:00:00"] == 500
    first = stacked.where("situation_date < '2025-05-30'").select("id")
    assert first.exceptAll(snapshots.half_snapshot(df)).isEmpty()


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path, rows):
    records = [f'{{"id": "{i}",\n "label": "{"Yes" if i % 3 else "No [x]"}"}}' for i in range(30_000)]
    (tmp_path / "a.json").write_text("[\n" + ",\n ".join(records) + "\n]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        labels = files.read_labels(spark, str(tmp_path), "array")
        assert labels.rdd.getNumPartitions() >= 4
        found = rows(labels)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted([(str(i), "Yes" if i % 3 else "No [x]") for i in range(30_000)], key=repr)


@pytest.mark.parametrize(
    "text",
    [
        '[{"id": "1", "label": "Yes"}, {"id": "2", "label": "No"}', '[{"id": "1", "label": "Yes"}, {"id": "2", "lab', '[{"id": "1"}, {"x": {"id": "2"}}]',
        '[{"id": "1", "label": "a}b"}]', '{"id": "1", "label": "Yes"}]', '[{}]', '[{"id": "1" "label": "Yes"}]', '[1, 2]', '[{"id": "1"}] trailing',
    ],
)
def test_arrays_that_are_cut_off_or_not_flat_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        files.read_labels(spark, str(tmp_path), "array").collect()


def test_empty_arrays_and_several_files(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text("[ ]\n")
    assert files.read_labels(spark, str(tmp_path), "array").count() == 0
    (tmp_path / "b.json").write_text('[{"id": 1, "label": "Yes", "more": [1]}, {"label": null, "id": "2"}]')
    assert rows(files.read_labels(spark, str(tmp_path), "array")) == [("1", "Yes"), ("2", None)]


@pytest.mark.parametrize(("copies", "reads"), [(1, 2), (30, 3)])
def test_half_snapshot_reads_the_table_twice(spark, copies, reads):
    """A third time where copies of one row lie on both sides of the middle."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(41).selectExpr("id", f"explode(sequence(1, {copies})) AS x").drop("x")
    half = snapshots.half_snapshot(rows.mapInPandas(counted, "id bigint"))
    assert half.count() == 41 * copies // 2
    assert seen.value == reads * 41 * copies


def test_counts_per_predicate_do_not_try_every_predicate_on_every_row(spark):
    ids = spark.sql("SELECT explode(array(-251, -250, -1, 0, 249, 250, 251, 999999, NULL, NULL)) AS id")
    few = _rows_per_range(ids, "id", relational.id_ranges(-500, 500, 250), True)
    many = _rows_per_range(ids, "id", relational.id_ranges(-500, 1_000_000, 250), True)
    size = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("\n")
    width = lambda frame: len(frame._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) == size(few) and width(many) < 1.1 * width(few)
    counts = {tuple(row) for row in many.collect()}
    assert counts == {(-500, 1, -251), (-250, 2, -251), (0, 2, 249), (250, 2, 501), (999750, 1, 999999), (None, 2, None)}


def test_counts_per_predicate_count_a_row_of_two_ranges_twice(spark, rows):
    ids = spark.range(-3, 12)
    assert rows(_rows_per_range(ids, "id", [(-2, 4), (3, 5), (9, 10), (9, 10)], False)) == [
        (-2, 6, 3), (3, 2, 7), (9, 2, 18)
    ]
    assert rows(_rows_per_range(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"), "id", [], True)) == [(None, 1, None)]
