"""Token ids packed into rows of one length, by best-fit decreasing.

Every document is encoded, ends with the separator id and, if it is longer than a row, is split into pieces of whole
rows and a rest. Pieces are dealt over shards by a hash; within a shard the longest go first, each into the fullest row
that still holds it, which a segment tree over the rows' free lengths finds. The result is a matrix of ids with, per
row, the document, piece number and document offset of each segment, the cumulative segment lengths (where attention
ends), and the places where positions start again.

Null and empty texts are a separator alone, so that every row of the input is in the result; null ids stay null. Strings
that look like special tokens are encoded as plain text. Rows that repeat are packed one by one; extra columns are not
read. The number of shards follows the bytes of text, so a shard holds about the same at every size of the input.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm.common import ship, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SEPARATOR = 50256
LENGTH = 2048
# Bytes of text whose tokens one task packs together.
SHARD_BYTES = 8_000_000
# Shards that go to one partition, so that partitions stay of one size, too.
SHARDS_A_TASK = 4
BATCH_TOKENS = 1_000_000
PIECES = "doc_id bigint, piece int, start bigint, n_tokens int, ids binary"
PACKED = (
    "shard bigint, row bigint, n_tokens int, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, "
    "cu_seqlens array<int>, position_resets array<int>, ids binary"
)
IDS = np.dtype("<u2")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The vocabulary's encoder, one per worker process."""
    import tiktoken

    with open(path, "rb") as source:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's ids, two bytes each, in pieces of at most ``length``."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary())])

    def encode(batches):
        encoder = encoding(vocabulary)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encoder.encode_ordinary(text.as_py() or ""), SEPARATOR], IDS)
                for number, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    rows.append((doc_id, number, start, len(part), part.tobytes()))
                size += len(ids)
                if size > BATCH_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


class FreeLengths:
    """Open rows by their free length, in a segment tree that counts the rows below each node."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = self.leaves + free
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """The row with the least free length of at least ``needed``, and that length."""
        node = self.leaves + needed
        if not self.count[node]:
            # Up to the first node whose right sibling has rows, then down to its leftmost leaf.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.rows[free].pop(), free


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """The items of each row; ``sizes`` are in decreasing order."""
    open_rows, rows = FreeLengths(length), []
    for item, size in enumerate(sizes):
        found = open_rows.take(size)
        if found is None:
            rows.append([item])
            row, free = len(rows) - 1, length
        else:
            row, free = found
            rows[row].append(item)
        if free > size:
            open_rows.add(free - size, row)
    return rows


def _packer(length: int, pad: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")]).combine_chunks()
        sizes, shard = group.column("n_tokens").to_pylist(), group.column("shard")[0].as_py()
        doc_ids, numbers, starts = (group.column(c).to_pylist() for c in ("doc_id", "piece", "start"))
        ids = group.column("ids")
        out = []
        for row, items in enumerate(best_fit(sizes, length)):
            ends = np.cumsum([sizes[i] for i in items])
            line = np.full(length, pad, IDS)
            line[: ends[-1]] = np.frombuffer(b"".join([ids[i].as_py() for i in items]), IDS)
            cuts = [0, *ends.tolist()]
            out.append((shard, row, int(ends[-1]), [doc_ids[i] for i in items], [numbers[i] for i in items], [starts[i] for i in items],
                        cuts, cuts[:-1] + ([int(ends[-1])] if ends[-1] < length else []), line.tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return pack


_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary()),
])


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of the matrices of all shards. ``ids`` has ``length`` two-byte ids, little-endian, padded with separators."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_of("text")) + 1)).first()[0] or 0
    shards = max(1, ceil(total / shard_bytes))
    dealt = pieces(docs, length, vocabulary).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "ids"), F.lit(shards)))
    dealt = dealt.repartition(ceil(shards / SHARDS_A_TASK), "shard")
    return dealt.groupBy("shard").applyInArrow(_packer(length, SEPARATOR), PACKED)


def positions(position_resets: list[int], length: int = LENGTH) -> np.ndarray:
    """Position ids of a row: they start again with every segment and with the padding."""
    resets = np.array(position_resets, np.int64)
    return np.arange(length) - np.repeat(resets, np.diff(np.append(resets, length)))


def matrix(ids: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Rows of ids as one matrix, without a copy of each."""
    return np.frombuffer(b"".join(ids), IDS).reshape(-1, length)


def write_matrices(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet files; every file holds whole shards, each with its rows in order."""
    rows.sortWithinPartitions("shard", "row").write.mode("overwrite").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The packed rows that were written to ``path``: ids, cumulative segment lengths and position resets."""
    return spark.read.schema(PACKED).parquet(path)


def unpacked(rows: DataFrame) -> DataFrame:
    """The documents' ids, read back from packed rows and joined piece by piece; the separator is taken off.

    doc_id and ``ids``, two bytes each. Rows of the input that repeat an id can't be told apart here.
    """
    segment = F.explode(F.arrays_zip("doc_ids", "starts", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("low"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("high")))
    cut = rows.select("ids", segment.alias("s")).select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"),
        F.substring(F.col("ids"), F.col("s.low") * 2 + 1, (F.col("s.high") - F.col("s.low")) * 2).alias("part"),
    )
    joined = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))
    whole = joined.select("doc_id", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["part"]))).alias("hexed"))
    return whole.select("doc_id", F.unhex(F.expr("substring(hexed, 1, length(hexed) - 4)")).alias("ids"))
