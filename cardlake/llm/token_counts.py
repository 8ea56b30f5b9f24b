"""Exact token counts of every prefix of every text, and what follows from them without encoding again.

A null text is empty: no bytes, no tokens, no prefixes. Special strings inside texts are special tokens, as the
vocabulary's own library has it; none are added. Rows that repeat are counted one by one; extra columns are not read.
Texts of any length are counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.llm.byte_bpe import tokenizer
from cardlake.llm.common import ship

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint, prefix_deltas binary"
# Bytes of texts whose results leave a task together.
BATCH_BYTES = 4_000_000


def _counter(path: str):
    def count(batches):
        own = tokenizer(path)
        for batch in batches:
            ids, n_bytes, n_tokens, deltas, size = [], [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                found = own.deltas(text)
                ids.append(doc_id)
                n_bytes.append(len(text.encode()))
                n_tokens.append(int(np.frombuffer(found, np.int8).sum(dtype=np.int64)))
                deltas.append(found)
                size += len(found)
                if size > BATCH_BYTES:
                    yield _batch(ids, n_bytes, n_tokens, deltas)
                    ids, n_bytes, n_tokens, deltas, size = [], [], [], [], 0
            if ids:
                yield _batch(ids, n_bytes, n_tokens, deltas)

    return count


def _batch(ids, n_bytes, n_tokens, deltas):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(deltas, pa.binary())],
        names=["doc_id", "n_bytes", "n_tokens", "prefix_deltas"],
    )


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """For every document its bytes, its tokens and ``prefix_deltas``, one signed byte per code point.

    The running sum of the deltas is the exact number of tokens of each prefix of the text.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counter(vocabulary), COUNTED)


def tokens_at(prefix_deltas: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(np.frombuffer(prefix_deltas, np.int8)[:n_chars].sum(dtype=np.int64))


def chars_within(prefix_deltas: bytes, n_tokens: int) -> int:
    """The longest prefix, in code points, that has at most ``n_tokens`` tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(prefix_deltas, np.int8), dtype=np.int64) <= n_tokens)
    return int(within[-1]) + 1 if len(within) else 0


def truncated(counts: DataFrame, limit: int) -> DataFrame:
    """The counts with over_limit and chars_in_limit, the code points to keep so that a text has ``limit`` tokens at most."""

    @F.pandas_udf("long")
    def chars(deltas):
        return deltas.map(lambda found: chars_within(found, limit))

    return counts.withColumn("over_limit", F.col("n_tokens") > limit).withColumn("chars_in_limit", chars("prefix_deltas"))
