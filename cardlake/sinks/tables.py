"""Catalog tables over Parquet: one external table serves both the catalog and the path readers.

A snapshot is written to a folder of its own before anything refers to it; then the table's location is switched to it
in one step. A write that fails at any point leaves the old snapshot in place for both kinds of readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardlake.schemas import DAY_PARTS
from cardlake.session import qualified
from cardlake.sinks.days import without_sort
from cardlake.sinks.versions import current_path, new_version, remove_old

# A table whose partitions are found by listing has one location, so that a single change switches all of it.
_LISTED = {"spark.sql.hive.manageFilesourcePartitions": "false"}


def write_table(
    df: DataFrame,
    table: str,
    path: str,
    partition_by: list[str] | None = DAY_PARTS,
    bucket_by: tuple[str, int] | None = None,
) -> None:
    """Write ``df`` as the table ``database.name`` stored below ``path``; the table then holds only this frame.

    ``bucket_by=("id", n)`` stores transactions and labels so that they can be joined on that key
    without a shuffle; leave it off where one key may hold much of the data.
    """
    spark, path = df.sparkSession, _prepare(df, table, path)
    folder = new_version(spark, path)
    _write(df, table, folder, partition_by, bucket_by)
    _switch(spark, table, folder, df, partition_by, bucket_by)
    remove_old(spark, path)


def replace_days(df: DataFrame, table: str, path: str) -> None:
    """Write the days in ``df`` and leave all other days of the table as they are.

    The days are replaced in the current snapshot, one by one when all of them are written. The files decide which
    days there are, so this also works from a new session whose catalog does not know the table yet.
    """
    spark, path = df.sparkSession, _prepare(df, table, path)
    folder = current_path(spark, path)
    if folder == path:
        folder = new_version(spark, path)
        _write(df, table, folder, DAY_PARTS, None)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*DAY_PARTS).parquet(folder)
    if not spark.catalog.tableExists(table):
        _switch(spark, table, folder, df, DAY_PARTS, None)
    spark.catalog.refreshTable(table)


def _write(df: DataFrame, table: str, folder: str, partition_by: list[str] | None, bucket_by: tuple[str, int] | None) -> None:
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not bucket_by:
        with without_sort(df.sparkSession):
            writer.save(folder)
        return
    # Only tables are written in buckets; the name is given up again at once, the files stay.
    own = f"{table}_{folder.rsplit('-', 1)[1]}"
    writer.option("path", folder).bucketBy(bucket_by[1], bucket_by[0]).sortBy(bucket_by[0]).saveAsTable(own)
    df.sparkSession.sql(f"DROP TABLE {own}")


def _layout(spark: SparkSession, table: str) -> tuple:
    """What a change of location keeps: columns, partitions and buckets."""
    columns = [(c.name, c.dataType, c.isPartition, c.isBucket) for c in spark.catalog.listColumns(table)]
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name IN ('Num Buckets', 'Partition Provider', 'Provider')")
    return sorted(columns), sorted(tuple(row)[:2] for row in rows.collect())


def _switch(
    spark: SparkSession, table: str, folder: str, df: DataFrame, partition_by: list[str] | None, bucket_by: tuple[str, int] | None
) -> None:
    """Let the table stand for a folder. A table of the same layout changes its location, any other is made anew."""
    before = {key: spark.conf.get(key) for key in _LISTED}
    own = f"{table}_next"
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema)
    parts = f"PARTITIONED BY ({', '.join(f'`{name}`' for name in partition_by)})" if partition_by else ""
    buckets = f"CLUSTERED BY (`{bucket_by[0]}`) SORTED BY (`{bucket_by[0]}`) INTO {bucket_by[1]} BUCKETS" if bucket_by else ""
    try:
        for key, value in _LISTED.items():
            spark.conf.set(key, value)
        spark.sql(f"DROP TABLE IF EXISTS {own}")
        spark.sql(f"CREATE TABLE {own} ({columns}) USING parquet {parts} {buckets} LOCATION '{folder}'")
        if spark.catalog.tableExists(table):
            if _layout(spark, table) == _layout(spark, own):
                spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
                spark.sql(f"DROP TABLE {own}")
            else:
                spark.sql(f"DROP TABLE {table}")
                spark.sql(f"ALTER TABLE {own} RENAME TO {table}")
        else:
            spark.sql(f"ALTER TABLE {own} RENAME TO {table}")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    spark.catalog.refreshTable(table)


def _prepare(df: DataFrame, table: str, path: str) -> str:
    """Create the table's database and return the full URI of its folder; a name without a database is refused."""
    database, _, name = table.partition(".")
    if not database or not name:
        raise ValueError(f"not a table name with a database: {table!r}")
    path = qualified(df.sparkSession, path)
    folder = path.rsplit("/", 1)[0]
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}'")
    return path
