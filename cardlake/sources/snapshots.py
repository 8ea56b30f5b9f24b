"""Daily snapshots of one table: half of it stamped with a first time, then all of it with a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlake.functions.hashing import hash_number
from cardlake.session import stored


def stamp(df: DataFrame, when: str) -> DataFrame:
    """Add the snapshot time as ``yyyy-MM-dd HH:mm:ss`` text."""
    return df.withColumn("situation_date", F.lit(when))


def half_snapshot(df: DataFrame) -> DataFrame:
    """``count // 2`` of the rows: those with the smallest row hashes, the same ones on every run.

    A limit of that size would send half of the table through one task. Here one pass stores the hash of every row,
    eight bytes each, and two small histograms of these give the value up to which rows are taken; the rest is a filter,
    for which the table is read a second time. Only where rows with exactly this hash are taken in part are they read
    and counted apart.
    """
    hashed = hash_number(df.columns, "half")
    hashes = stored(df.select(hashed.alias("hash")), "row-hashes")
    cell = F.shiftright("hash", 16)
    per_cell = _counts(hashes, cell)
    if not per_cell:
        return df
    target = sum(count for _, count in per_cell) // 2
    last_cell, below = _boundary(per_cell, target, 0)
    last_hash, below = _boundary(_counts(hashes.where(cell == last_cell), F.col("hash")), target, below)
    half = df.where(hashed < last_hash)
    if below == target:
        return half
    return half.unionByName(_first_rows(df.where(hashed == last_hash), target - below))


def stack_snapshots(df: DataFrame, first: str, second: str) -> DataFrame:
    """Half of the rows stamped ``first`` and all rows stamped ``second``."""
    return stamp(half_snapshot(df), first).unionByName(stamp(df, second))


def _counts(df: DataFrame, key: Column) -> list[tuple[int, int]]:
    """Rows per key in key order; there are at most 65 536 keys."""
    return sorted((row["k"], row["n"]) for row in df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).collect())


def _boundary(counts: list[tuple[int, int]], target: int, below: int) -> tuple[int, int]:
    """The first key whose rows lead past ``target``, and the number of rows before it."""
    for key, count in counts:
        if below + count > target:
            return key, below
        below += count
    raise ValueError("the rows changed while they were counted")


_BLOCK = 1_000_000


def _first_rows(tied: DataFrame, n: int) -> DataFrame:
    """``n`` of the rows in column order, where few distinct rows may have many copies.

    Copies are counted before they meet, and written out again in blocks spread over the tasks.
    """
    counted = tied.groupBy(*tied.columns).agg(F.count("*").alias("_copies"))
    # One hash value: a handful of distinct rows, so one window is enough.
    before = F.sum("_copies").over(Window.orderBy(*tied.columns).rowsBetween(Window.unboundedPreceding, -1))
    wanted = F.least("_copies", F.lit(n) - F.coalesce(before, F.lit(0)))
    kept = counted.withColumn("_copies", wanted).where("_copies > 0")
    blocks = kept.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / _BLOCK))).alias("_block"))
    size = F.least(F.lit(_BLOCK), F.col("_copies") - F.col("_block") * _BLOCK)
    copies = blocks.repartition("_block").select(*tied.columns, F.explode(F.sequence(F.lit(1), size)))
    return copies.select(*tied.columns)
