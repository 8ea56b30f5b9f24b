"""Hashes of rows and keys: the same on every engine and for every partitioning of the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(keys: str | list[str], seed: str) -> Column:
    """A number below 2^32: the first 32 bits of md5("seed:key:key..."); nulls are skipped."""
    columns = [F.col(key).cast("string") for key in ([keys] if isinstance(keys, str) else keys)]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *columns))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(keys: str | list[str], buckets: int, seed: str) -> Column:
    """Bucket 0 .. buckets-1."""
    return F.pmod(hash_number(keys, seed), F.lit(buckets)).cast("int")
