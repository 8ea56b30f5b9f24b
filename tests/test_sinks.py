import csv
import os
from datetime import date, datetime
from pathlib import Path
from unittest import mock

import pytest
from pyspark.sql import DataFrame, DataFrameWriter

from cardlake.sinks import exports, relational, tables
from cardlake.sinks.days import OPEN_FILES, write_by_situation_date, write_ingestion_day
from cardlake.sinks.tables import replace_days, write_table
from cardlake.sinks.versions import current_path, read_current, versions
from cardlake.sources import days

SCHEMA = "id int, situation_date string"


def test_rerun_of_bronze_adds_nothing(spark, tmp_path, rows):
    root = str(tmp_path / "bronze")
    df = spark.createDataFrame([(1, "2025-05-29 10:00:00"), (2, "2025-05-30 10:00:00"), (3, None), (4, "?")], SCHEMA)
    first = write_by_situation_date(df, root)
    once = rows(spark.read.parquet(root), "id", "year", "month", "day")
    assert write_by_situation_date(df, root) == first == {"n_rows": 4, "n_undated": 2}
    assert rows(spark.read.parquet(root), "id", "year", "month", "day") == once
    assert once == sorted([(1, 2025, 5, 29), (2, 2025, 5, 30), (3, None, None, None), (4, None, None, None)], key=repr)
    assert days.newest_day(spark, root) == (2025, 5, 30)


def test_a_later_day_leaves_the_earlier_ones(spark, tmp_path, rows):
    root = str(tmp_path / "bronze")
    write_by_situation_date(spark.createDataFrame([(1, "2025-05-29")], SCHEMA), root)
    write_by_situation_date(spark.createDataFrame([(2, "2025-05-30")], SCHEMA), root)
    assert rows(spark.read.parquet(root), "id") == [(1,), (2,)]


def test_append_loads_ranges_one_by_one(spark, tmp_path, rows):
    root = str(tmp_path / "bronze")
    for number in (1, 2):
        frame = spark.createDataFrame([(number, "2025-05-29")], SCHEMA)
        write_by_situation_date(frame, root, mode="append", rebalance=False)
    assert rows(spark.read.parquet(root), "id") == [(1,), (2,)]


def test_ingestion_day_folder_is_padded_and_replaced(spark, tmp_path, rows):
    root = str(tmp_path / "cards")
    write_ingestion_day(spark.range(5), root, date(2025, 5, 8))
    write_ingestion_day(spark.range(5), root, date(2025, 5, 9))
    assert write_ingestion_day(spark.range(3), root, date(2025, 5, 9)) == 3
    assert (tmp_path / "cards" / "year=2025" / "month=05" / "day=09").is_dir()
    assert spark.read.parquet(root).count() == 8
    assert rows(days.read_days(spark, root)) == [(i, 2025, 5, 9) for i in range(3)]


def day_frame(spark, day, ids):
    return spark.createDataFrame([(i, 2025, 5, day) for i in ids], "id int, year int, month int, day int")


def test_table_holds_one_snapshot_by_default(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    write_table(day_frame(spark, 8, [1, 2]), "sink_a.t", path)
    write_table(day_frame(spark, 9, [3]), "sink_a.t", path)
    assert rows(spark.table("sink_a.t")) == [(3, 2025, 5, 9)]
    assert rows(read_current(spark, path)) == [(3, 2025, 5, 9)]


def test_relative_path_is_not_put_below_the_warehouse(spark, tmp_path, rows):
    where = Path(spark._jvm.java.io.File("").getAbsolutePath())
    relative = os.path.relpath(tmp_path / "t", where)
    write_table(day_frame(spark, 8, [1]), "sink_d.t", relative)
    assert rows(read_current(spark, f"{tmp_path}/t"), "id") == [(1,)]


@pytest.mark.parametrize("known_table", [True, False])
def test_single_days_are_replaced(spark, tmp_path, rows, known_table):
    path, table = f"{tmp_path}/t", f"sink_b.t_{known_table}"
    for day, ids in ((8, [1, 2]), (9, [3]), (9, [4])):
        replace_days(day_frame(spark, day, ids), table, path)
        if not known_table:
            spark.sql(f"DROP TABLE {table}")
    if not known_table:
        replace_days(day_frame(spark, 9, [4]), table, path)
    expected = [(1, 2025, 5, 8), (2, 2025, 5, 8), (4, 2025, 5, 9)]
    assert rows(spark.table(table)) == expected
    assert rows(read_current(spark, path)) == expected


def test_days_can_be_added_to_a_snapshot_table(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    write_table(day_frame(spark, 8, [1, 2]), "sink_e.t", path)
    replace_days(day_frame(spark, 9, [3]), "sink_e.t", path)
    assert rows(spark.table("sink_e.t"), "id") == [(1,), (2,), (3,)]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    for name in ("facts", "labels"):
        frame = spark.range(1000).selectExpr("id", f"'{name}' AS {name}")
        write_table(frame, f"sink_c.{name}", f"{tmp_path}/{name}", partition_by=None, bucket_by=("id", 4))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("sink_c.facts").join(spark.table("sink_c.labels"), "id", "left")
        assert joined.count() == 1000
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bucket_by", [None, ("id", 4)])
def test_a_write_that_fails_halfway_leaves_the_old_snapshot(spark, tmp_path, rows, bucket_by):
    path, table = f"{tmp_path}/t", f"sink_f.t{bucket_by is None}"
    write_table(day_frame(spark, 8, [1, 2]), table, path, bucket_by=bucket_by)
    before = current_path(spark, path)
    broken = day_frame(spark, 9, range(100)).repartition(8, "id").selectExpr("if(id = 77, raise_error('lost'), id) AS id", "year", "month", "day")
    broken = broken.selectExpr("cast(id as int) AS id", "year", "month", "day")
    with pytest.raises(Exception, match="lost"):
        write_table(broken, table, path, bucket_by=bucket_by)
    assert rows(spark.table(table), "id") == rows(read_current(spark, path), "id") == [(1,), (2,)]
    write_table(day_frame(spark, 9, [5]), table, path, bucket_by=bucket_by)
    assert rows(spark.table(table), "id") == rows(read_current(spark, path), "id") == [(5,)]
    # What was not finished is gone, the snapshot before is kept for its readers.
    assert [folder for _, folder, _ in versions(spark, path)] == [before, current_path(spark, path)]
    assert spark.read.parquet(before).count() == 2


def test_a_table_that_is_read_does_not_change_under_its_readers(spark, tmp_path, rows):
    path, table = f"{tmp_path}/t", "sink_g.t"
    write_table(day_frame(spark, 8, [1, 2]), table, path)
    reader = spark.table(table)
    other = spark.newSession().table(table)
    write_table(reader.selectExpr("id + 10 AS id", "year", "month", "day"), table, path)
    assert rows(reader, "id") == rows(other, "id") == [(1,), (2,)]
    assert rows(spark.table(table), "id") == rows(spark.newSession().table(table), "id") == [(11,), (12,)]


def test_a_switch_that_fails_leaves_whole_snapshots(spark, tmp_path, rows):
    path, table = f"{tmp_path}/t", "sink_h.t"
    write_table(day_frame(spark, 8, [1]), table, path)
    with mock.patch.object(tables, "_switch", side_effect=RuntimeError("killed")), pytest.raises(RuntimeError):
        write_table(day_frame(spark, 9, [2]), table, path)
    assert rows(spark.table(table), "id") == [(1,)] and rows(read_current(spark, path), "id") == [(2,)]
    write_table(day_frame(spark, 9, [3]), table, path)
    assert rows(spark.table(table), "id") == rows(read_current(spark, path), "id") == [(3,)]


def test_a_new_layout_makes_the_table_anew(spark, tmp_path, rows):
    path, table = f"{tmp_path}/t", "sink_i.t"
    write_table(day_frame(spark, 8, [1]), table, path)
    write_table(spark.range(2).selectExpr("id", "'x' AS more"), table, path, partition_by=None)
    assert spark.table(table).columns == ["id", "more"] and spark.table(table).count() == 2
    write_table(spark.range(2).selectExpr("id", "'x' AS more"), table, path, partition_by=None, bucket_by=("id", 2))
    assert spark.table(table).count() == 2
    write_table(day_frame(spark, 9, [4]).limit(0), table, path)
    assert spark.table(table).columns == ["id", "year", "month", "day"] and spark.table(table).count() == 0


def test_partitions_of_a_version_are_pruned(spark, tmp_path):
    path, table = f"{tmp_path}/t", "sink_j.t"
    write_table(day_frame(spark, 8, [1]).unionByName(day_frame(spark, 9, [2])), table, path)
    one = spark.table(table).where("day = 9")
    assert [name.split("/")[-2] for name in one.inputFiles()] == ["day=9"] or "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/plain")
    assert current_path(spark, f"{tmp_path}/plain") == f"{tmp_path}/plain"
    assert read_current(spark, f"{tmp_path}/plain").count() == 3


def test_a_table_name_needs_its_database(spark, tmp_path):
    with pytest.raises(ValueError, match="database"):
        write_table(day_frame(spark, 8, [1]), "lonely", f"{tmp_path}/t")
    assert not spark.catalog.databaseExists("lonely")


@pytest.mark.parametrize(("connections", "parts"), [(None, 9), (3, 3), (20, 9)])
def test_jdbc_write_limits_connections(spark, connections, parts):
    seen = {}

    def jdbc(writer, url, table, mode=None, properties=None):
        seen.update(url=url, table=table, mode=mode, properties=properties, parts=writer._df.rdd.getNumPartitions())

    with mock.patch.object(DataFrameWriter, "jdbc", jdbc):
        relational.write_jdbc(spark.range(100).repartition(9), "jdbc:x", "dm_cartes", {"user": "u"}, connections=connections)
    assert seen == {
        "url": "jdbc:x",
        "table": "dm_cartes",
        "mode": "overwrite",
        "properties": {"batchsize": "10000", "user": "u"},
        "parts": parts,
    }


def test_csv_export_has_a_header_and_a_time_stamp(spark, tmp_path):
    df: DataFrame = spark.createDataFrame([("a,b", 1), ('say "x"', None)], "name string, n int")
    path = exports.export_csv(df, str(tmp_path), datetime(2025, 5, 30, 13, 32, 53))
    assert "/query_2025-05-30_13-32-53_" in path
    assert exports.export_csv(df, str(tmp_path), datetime(2025, 5, 30, 13, 32, 53)) != path
    lines = [row for part in Path(path).glob("*.csv") for row in csv.DictReader(part.open())]
    assert sorted(lines, key=str) == [{"name": "a,b", "n": "1"}, {"name": 'say "x"', "n": ""}]


def test_writes_by_days_keep_few_files_open_and_lose_no_day(spark, tmp_path):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(key), []
    raw = spark.sql("SELECT id, concat('2025-05-', 1 + id % 7) AS situation_date FROM range(0, 700, 1, 3)")
    parquet = DataFrameWriter.parquet
    with mock.patch.object(DataFrameWriter, "parquet", lambda *a: seen.append(spark.conf.get(key)) or parquet(*a)):
        # Without rebalance each task has seven days, more than it may keep open.
        write_by_situation_date(raw, str(tmp_path / "lake"), rebalance=False)
    assert [int(n) for n in seen] == [OPEN_FILES] and spark.conf.get(key) == before
    counts = spark.read.parquet(str(tmp_path / "lake")).groupBy("day").agg({"id": "count"}).collect()
    assert sorted(map(tuple, counts)) == [(day, 100) for day in range(1, 8)]
