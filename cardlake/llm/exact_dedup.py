"""Exact duplicates through an extendible-hash index on shared files.

Texts are equal when they agree byte for byte after every run of white space has become one blank. The index has one
entry per distinct text. Its hash is 64 bits of the text; a directory maps hash prefixes to buckets, and a bucket with
more entries than its capacity is split by one more bit of prefix until all fit. As copies share one entry, a group of
copies never overfills a bucket, however large it is. Buckets are ranges of hashes: one owner task sorts and writes
each. Different texts with one hash are chained as separate entries, which the comparison of whole texts tells apart.

Rows without a text count as empty texts, rows without an id sort after all others. Of rows that repeat both id and
text, each is reported as kept by :func:`groups`; :func:`deduplicated` leaves one.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlake.llm.common import SPACES, id_of, public_id, stored, text_of
from cardlake.session import scratch_dir

# Entries of a bucket; one owner task sorts one bucket.
CAPACITY = 100_000


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACES, " ")


def text_key(text: Column, bits: int = 64) -> Column:
    """The first ``bits`` bits of the hash; fewer bits force collisions, for tests."""
    key = F.xxhash64(text)
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def _prefix(depth: int, key: str = "key") -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def entries(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, key and digest, without the text."""
    rows = docs.select(id_of().alias("id"), normalised().alias("norm"))
    return rows.select("id", text_key(F.col("norm"), bits).alias("key"), F.sha2("norm", 256).alias("text_sha256"))


def chains(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per distinct text: key, digest, smallest id and number of copies.

    Grouping by the whole text compares bytes. Copies are merged before the shuffle, so that each task sends one row
    of a group, whatever its size.
    """
    rows = docs.select(id_of().alias("id"), normalised().alias("norm"))
    grouped = rows.groupBy(text_key(F.col("norm"), bits).alias("key"), "norm").agg(
        F.min("id").alias("head"), F.count(F.lit(1)).alias("size")
    )
    return grouped.select("key", F.sha2("norm", 256).alias("text_sha256"), "head", "size")


def directory(index: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int, int]:
    """Buckets of the index: hash prefix, its depth and the number of entries; and the global depth and the buckets.

    Starts at the depth at which evenly spread entries fit, then doubles for overfull buckets only. A bucket whose
    entries share all bits of the key can't be split: it stays as an overflow chain.
    """
    total = index.count()
    depth = ceil(log2(total / capacity)) if total > capacity else 0
    counted = index.groupBy(_prefix(depth).alias("prefix")).agg(
        F.count(F.lit(1)).alias("entries"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    open_buckets = stored(counted.withColumn("depth", F.lit(depth)), "directory")
    settled = []
    while True:
        overfull = (F.col("entries") > capacity) & (F.col("low") != F.col("high"))
        settled.append(open_buckets.filter(~overfull))
        if depth >= 64 or open_buckets.filter(overfull).isEmpty():
            break
        parents = open_buckets.filter(overfull).select(F.col("prefix").alias("parent"))
        inside = index.join(parents, _prefix(depth) == F.col("parent"), "left_semi")
        depth += 1
        split = inside.groupBy(_prefix(depth).alias("prefix")).agg(
            F.count(F.lit(1)).alias("entries"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        open_buckets = stored(split.withColumn("depth", F.lit(depth)), "directory")
    buckets = settled[0]
    for more in settled[1:]:
        buckets = buckets.unionByName(more)
    return buckets, depth, max(1, ceil(2 * total / capacity))


def build_index(docs: DataFrame, path: str, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """Write the index of ``docs`` below ``path``, a shared folder, and return it with each entry's bucket.

    ``bucket`` is the first hash of the bucket's range in text order, ``depth`` the bits that its entries share.
    """
    spark = docs.sparkSession
    index = stored(chains(docs, bits), "chains")
    buckets, depth, owners = directory(index, capacity)
    # The directory has one slot per prefix of the global depth; a shallow bucket holds several neighbouring slots.
    span = f"cast({depth} - depth as int)"
    slots = buckets.select(
        "prefix", "depth",
        F.explode(F.expr(f"sequence(shiftleft(prefix, {span}), shiftleft(prefix, {span}) + shiftleft(1L, {span}) - 1)")).alias("slot"),
    )
    owned = index.join(slots, _prefix(depth) == F.col("slot")).select(
        *index.columns, "depth", F.format_string("%02d-%016x", F.col("depth"), F.col("prefix")).alias("bucket")
    )
    (
        owned.repartitionByRange(owners, "key").sortWithinPartitions("bucket", "key")
        .write.mode("overwrite").partitionBy("bucket").parquet(path)
    )
    return spark.read.schema(owned.schema).parquet(path)


def lookup(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Every row of :func:`entries` with the entry of its text. A hot key is split by the adaptive join."""
    found = index.select("key", "text_sha256", "head", "size")
    return rows.join(found, ["key", "text_sha256"])


def groups(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """For every row of ``docs``: doc_id, keep_id, group_size, kept and text_sha256."""
    rows = stored(entries(docs, bits), "entries")
    index = build_index(docs, scratch_dir(docs.sparkSession, "exact-index"), capacity, bits)
    return lookup(rows, index).select(
        public_id("id").alias("doc_id"),
        public_id("head").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("id") == F.col("head")).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group."""
    index = build_index(docs, scratch_dir(docs.sparkSession, "exact-index"), capacity)
    heads = index.select(F.col("head").alias("__llm_head"), F.col("text_sha256").alias("__llm_sha"))
    named = docs.select(*docs.columns, id_of().alias("__llm_id"), F.sha2(normalised(), 256).alias("__llm_row_sha"))
    first = Window.partitionBy("__llm_id", "__llm_row_sha").orderBy("__llm_id")
    kept = named.join(heads, (F.col("__llm_id") == F.col("__llm_head")) & (F.col("__llm_row_sha") == F.col("__llm_sha")), "left_semi")
    return kept.withColumn("__llm_copy", F.row_number().over(first)).filter("__llm_copy = 1").select(*docs.columns)
