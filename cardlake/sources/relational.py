"""Reading a relational table in id ranges, all ranges in parallel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SIZE = 3_000_000


@dataclass(frozen=True)
class Bounds:
    """The smallest and largest id of a table, None without ids, and the rows without an id."""

    least: int | None
    most: int | None
    missing: int


def id_ranges(start: int, end: int, size: int = DEFAULT_SIZE, count: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges of ``size`` ids, or ``count`` ranges, from ``start`` until ``end`` is covered.

    The last range is full width too.
    """
    if count is not None:
        if count <= 0:
            raise ValueError("count must be positive")
        size = max(1, -(-(end - start) // count))
    if size <= 0:
        raise ValueError("size must be positive")
    return [(low, low + size) for low in range(start, end, size)]


def outside_ranges(bounds: Bounds, inside: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges, as wide as those of a window, for the ids below and above it."""
    if not inside:
        raise ValueError("no id ranges")
    if bounds.least is None:
        return []
    (low, after), high = inside[0], inside[-1][1]
    size = after - low
    first = low - -(-max(0, low - bounds.least) // size) * size
    return id_ranges(first, low, size) + id_ranges(high, bounds.most + 1, size)


def range_predicates(ranges: list[tuple[int, int]], id_column: str = "id", missing: bool = False) -> list[str]:
    """One SQL predicate per range; ``missing`` adds one for rows without an id."""
    if not ranges and not missing:
        raise ValueError("no id ranges")
    predicates = [f"{id_column} >= {low} AND {id_column} < {high}" for low, high in ranges]
    return predicates + [f"{id_column} IS NULL"] * missing


def bounds_query(table: str, id_column: str = "id") -> str:
    """Subquery for the bounds of a table's ids."""
    return (
        f"(SELECT MIN({id_column}) AS least, MAX({id_column}) AS most, COUNT(*) - COUNT({id_column}) AS missing "
        f"FROM {table}) bounds"
    )


def _bounds(rows: DataFrame) -> Bounds:
    row = rows.first()
    whole = [None if value is None else int(value) for value in (row["least"], row["most"], row["missing"])]
    return Bounds(*whole)


def jdbc_bounds(spark: SparkSession, url: str, table: str, properties: dict[str, str], id_column: str = "id") -> Bounds:
    """The bounds, computed by the database."""
    return _bounds(spark.read.jdbc(url=url, table=bounds_query(table, id_column), properties=properties))


def view_bounds(spark: SparkSession, view: str, id_column: str = "id") -> Bounds:
    return _bounds(spark.sql(f"SELECT * FROM {bounds_query(view, id_column)}"))


def jdbc_rows_outside(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], ranges: list[tuple[int, int]], id_column: str = "id"
) -> int:
    """Rows that a window of ranges leaves out, counted by the database; those without an id among them."""
    low, high = ranges[0][0], ranges[-1][1]
    outside = f"{id_column} < {low} OR {id_column} >= {high} OR {id_column} IS NULL"
    query = f"(SELECT COUNT(*) AS n_rows FROM {table} WHERE {outside}) outside"
    return int(spark.read.jdbc(url=url, table=query, properties=properties).first()["n_rows"])


def read_jdbc_ranges(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    ranges: list[tuple[int, int]] | None = None,
    id_column: str = "id",
    size: int = DEFAULT_SIZE,
    count: int | None = None,
    everything: bool = False,
) -> DataFrame:
    """One partition per id range; a failing range fails the job, an empty one adds no rows.

    Without ``ranges`` the database is asked for its smallest and largest id, and every row is read, those without an
    id in a partition of their own. With them, ``everything`` adds the ids on both sides in ranges of the same width,
    and the rows without an id. Rows are fetched in blocks (``fetchsize``), so that a range never has to fit in a
    task's memory.
    """
    if ranges is not None and not ranges:
        raise ValueError("no id ranges")
    missing = False
    if ranges is None or everything:
        bounds = jdbc_bounds(spark, url, table, properties, id_column)
        missing = bounds.missing > 0
        if ranges is not None:
            ranges = sorted(ranges + outside_ranges(bounds, ranges))
        elif bounds.least is not None:
            ranges = id_ranges(bounds.least, bounds.most + 1, size, count)
        else:
            ranges, missing = [], True
    return spark.read.jdbc(
        url=url, table=table, predicates=range_predicates(ranges, id_column, missing),
        properties={"fetchsize": "10000", **properties},
    )


def range_counts(df: DataFrame, id_column: str, start: int, end: int, size: int) -> DataFrame:
    """Rows per id range, empty ranges included, and the rows that no range covers. ``df`` is read once."""
    ranges = id_ranges(start, end, size)
    first, last = ranges[0][0], ranges[-1][1]
    key = F.col(id_column)
    position = (
        F.when(key.isNull(), "missing").when(key < first, "below").when(key >= last, "above").otherwise("in range")
    )
    counted = (
        df.select(
            position.alias("position"),
            F.when(position == "in range", key - F.pmod(key - first, F.lit(size))).cast("bigint").alias("range_start"),
            key.alias("_id"),
        )
        .groupBy("position", "range_start")
        .agg(F.count("*").alias("n_rows"), F.min("_id").alias("min_id"), F.max("_id").alias("max_id"))
    )
    id_type = dict(df.dtypes)[id_column]
    every_range = df.sparkSession.range(start, end, size).select(
        F.lit("in range").alias("position"), F.col("id").alias("range_start"), F.lit(0).cast("bigint").alias("n_rows"),
        F.lit(None).cast(id_type).alias("min_id"), F.lit(None).cast(id_type).alias("max_id"),
    )
    summed = counted.unionByName(every_range).groupBy("position", "range_start").agg(
        F.sum("n_rows").alias("n_rows"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id")
    )
    return summed.withColumn("is_empty", F.col("n_rows") == 0)
