"""Windows of ids appended to date-partitioned Parquet, each window of a day once.

A ledger beside the data, ``<root>_loads/ledger``, says which ids of which day are loaded. A load begins with an entry
``started``, writes its rows to a folder of its own, moves the files into the days under its name, and ends with one
entry ``committed`` per day. Rows of ids that the ledger has for their day are left out, so the same window twice, or
windows that overlap, load every row once. A load that died is found by its entry: the next one deletes the files that
carry its name, and nothing else, so no step can lose or double rows of other loads.

A day's ids count as complete when they are loaded. Loads of one root must not run at the same time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardlake.functions.dates import with_day_parts
from cardlake.schemas import DAY_PARTS

LEDGER = "load string, state string, day date, low bigint, last bigint, n_rows bigint"
STARTED, COMMITTED, UNDONE = "started", "committed", "undone"
# The window of all ids; rows without an id are in it.
EVERY_ID = (-(2**63), 2**63 - 1)


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}_loads"


def entries(spark: SparkSession, root: str) -> DataFrame:
    """All entries of the ledger; none where there is no ledger yet."""
    path = f"{_folder(root)}/ledger"
    fs, target = _fs(spark, path)
    return spark.read.schema(LEDGER).parquet(path) if fs.exists(target) else spark.createDataFrame([], LEDGER)


def record(rows: DataFrame, root: str) -> None:
    """Add entries, all at once: they are one file."""
    rows.select("load", "state", "day", "low", "last", "n_rows").coalesce(1).write.mode("append").parquet(f"{_folder(root)}/ledger")


def held_ranges(ledger: DataFrame) -> DataFrame:
    """First and last id of what is loaded for each day; ranges that overlap or touch are one. A null day is a day."""
    committed = ledger.where(F.col("state") == COMMITTED).select("day", "low", "last").distinct()
    in_order = Window.partitionBy("day").orderBy("low", "last")
    before = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    # The smallest id has none before it to touch.
    begins = F.coalesce((F.col("low") > before) & (F.try_subtract("low", F.lit(1)) > before), F.lit(True))
    begun = committed.withColumn("begins", begins.cast("int"))
    return (
        begun.withColumn("range", F.sum("begins").over(in_order))
        .groupBy("day", "range").agg(F.min("low").alias("low"), F.max("last").alias("last")).drop("range")
    )


def with_held(dated: DataFrame, held: DataFrame, id_column: str = "id") -> DataFrame:
    """Add ``_held``: whether a row's id is loaded for its day. Days are joined; of their few ranges one fits at most."""
    ranges = held.select(F.col("day").alias("_day"), F.col("low").alias("_low"), F.col("last").alias("_last"))
    # Rows without an id are loaded by loads of every id only.
    number = F.coalesce(F.col(id_column).cast("bigint"), F.lit(EVERY_ID[0]))
    same_day = F.col("situation_date").eqNullSafe(F.col("_day"))
    joined = dated.join(ranges, same_day & number.between(F.col("_low"), F.col("_last")), "left")
    return joined.withColumn("_held", F.col("_low").isNotNull()).drop("_day", "_low", "_last")


def interrupted(ledger: DataFrame) -> DataFrame:
    """Loads that began and neither ended nor were undone."""
    ended = ledger.where(F.col("state") != STARTED).select("load")
    return ledger.where(F.col("state") == STARTED).join(ended, "load", "left_anti")


def undo_interrupted(spark: SparkSession, root: str) -> list[str]:
    """Delete the files of loads that died, and say so in the ledger; returns the loads."""
    broken = interrupted(entries(spark, root))
    # One row for each load that died since the last one that did not.
    names = [row["load"] for row in broken.select("load").collect()]
    for name in names:
        fs, files = _fs(spark, f"{root}/year=*/month=*/day=*/load-{name}-*")
        for status in fs.globStatus(files) or []:
            fs.delete(status.getPath(), False)
        for left in (_staging(root, name), f"{_staging(root, name)}-days"):
            fs.delete(_fs(spark, left)[1], True)
    if names:
        record(spark.createDataFrame([(name, UNDONE, None, None, None, None) for name in names], LEDGER), root)
    return names


def _staging(root: str, load: str) -> str:
    return f"{_folder(root)}/staging-{load}"


def _publish(spark: SparkSession, root: str, load: str) -> None:
    """Move the files of a load into the days; each is moved as a whole."""
    fs, files = _fs(spark, f"{_staging(root, load)}/_held=false/year=*/month=*/day=*/part-*")
    for status in fs.globStatus(files) or []:
        source = status.getPath()
        day = "/".join(part.getName() for part in (source.getParent().getParent().getParent(), source.getParent().getParent(), source.getParent()))
        folder = _fs(spark, f"{root}/{day}")[1]
        fs.mkdirs(folder)
        if not fs.rename(source, _fs(spark, f"{root}/{day}/load-{load}-{source.getName()}")[1]):
            raise OSError(f"can't move {source} into {folder}")


def load_window(rows: DataFrame, root: str, window: tuple[int, int] = EVERY_ID, id_column: str = "id", rebalance: bool = True) -> dict[str, int]:
    """Append the rows of a window, first and last id, that are not loaded yet.

    Returns the rows written, those among them without a date, and those that were loaded before. Rows outside the
    window are an error, as the ledger would not know of them. ``rows`` is read once.
    """
    spark, (low, last), load = rows.sparkSession, window, uuid.uuid4().hex
    undo_interrupted(spark, root)
    record(spark.createDataFrame([(load, STARTED, None, low, last, None)], LEDGER), root)
    number = F.col(id_column).cast("bigint")
    outside = ~F.coalesce(number.between(low, last), F.lit(window == EVERY_ID))
    checked = rows.where(F.when(outside, F.raise_error(F.lit("a row outside the window of ids")).cast("boolean")).otherwise(True))
    staged = with_held(with_day_parts(checked), held_ranges(entries(spark, root)), id_column)
    if rebalance:
        staged = staged.hint("rebalance", "_held", *DAY_PARTS)
    # Rows that are held go to a folder that is not published, so that they are counted and the source is read once.
    staging = _staging(root, load)
    staged.write.mode("overwrite").partitionBy("_held", *DAY_PARTS).parquet(staging)
    counts = spark.read.schema(staged.schema).parquet(staging).groupBy("_held", F.col("situation_date").alias("day")).agg(F.count("*").alias("n_rows"))
    ended = counts.select(
        F.lit(load).alias("load"), F.lit(COMMITTED).alias("state"), "day", F.lit(low).alias("low"), F.lit(last).alias("last"), "n_rows", "_held"
    )
    # Written out before the files move, as the counts are read from them. There is a row a day.
    known = f"{staging}-days"
    ended.coalesce(1).write.mode("overwrite").parquet(known)
    ended = spark.read.schema(ended.schema).parquet(known)
    _publish(spark, root, load)
    committed = ended.where("not _held")
    nothing = spark.createDataFrame([(load, UNDONE, None, None, None, None)], LEDGER)
    record(nothing if committed.isEmpty() else committed, root)
    fresh = F.when(~F.col("_held"), F.col("n_rows")).otherwise(0)
    total = ended.agg(
        F.sum(fresh).alias("n_rows"), F.sum(F.when(F.col("day").isNull(), fresh)).alias("n_undated"),
        F.sum(F.when(F.col("_held"), F.col("n_rows"))).alias("n_held"),
    ).first()
    fs, target = _fs(spark, staging)
    fs.delete(target, True)
    fs.delete(_fs(spark, known)[1], True)
    return {name: total[name] or 0 for name in ("n_rows", "n_undated", "n_held")}


def record_whole_days(spark: SparkSession, root: str, days: list) -> None:
    """Say that days were written with all their ids, so that later windows add nothing to them."""
    load = uuid.uuid4().hex
    if days:
        record(spark.createDataFrame([(load, COMMITTED, day, *EVERY_ID, None) for day in days], LEDGER), root)
