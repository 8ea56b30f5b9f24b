"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and links between overlapping tokens.

Both tokenizers encode the same bytes: a blank and the text. Two tokens overlap if they share a byte; the components of
that relation are the groups. Every token points to the overlapping token that reaches farthest right, and of two that
end together to that of B. Pointers are doubled for all tokens of many texts at once until none changes; then each
points to the last token of its group, which labels it. Groups never cross texts, as both tokenizers end with the text.

A link's count is the number of documents that hold its pair of ids, over the whole corpus. The most frequent pairs, at
most ``FREQUENT`` of them, are looked up in a broadcast table; every other pair occurs in so few documents that the join
on it has no hot key: at most 1.1 times the corpus's distinct links, divided by ``FREQUENT``.

Null and empty texts, and those whose tokens do not give back the blank and the text (U+2581 inside a text), have no
tokens, groups or links. Strings of special tokens are plain text. Rows that repeat are aligned one by one and each
counts as a document; null ids stay null; extra columns are not read. Texts of any length are aligned whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.llm.byte_bpe import byte_letters
from cardlake.llm.common import ship, stored

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# The same vocabulary for a faster library.
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
# Rows of the broadcast table of pairs.
FREQUENT = 2**16
# Counts are compared in so many classes for each doubling.
CLASSES = 8
# Bytes of texts that are aligned together.
GROUP_BYTES = 1_000_000
# Runs of so many bytes without a change between blank and other go to the library that takes long words in any number.
LONG_RUN = 400
GROUPS = "doc_id bigint, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>"
LINKS = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "links array<struct<pair:bigint,times:int>>"
)


@dataclass
class Aligned:
    """Tokens of several texts, one after the other; ``a_at`` and ``b_at`` have the first token of each text and the end."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    group_at: np.ndarray
    a_links: np.ndarray
    b_links: np.ndarray
    link_at: np.ndarray


def terminals(succ: np.ndarray) -> np.ndarray:
    """Where every chain of pointers ends: pointers are doubled until none changes."""
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


def long_runs(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts of a buffer hold a run of LONG_RUN bytes or more without a change between blank and other."""
    blank = data <= 32
    changes = np.flatnonzero(np.append(True, blank[1:] != blank[:-1]))
    long = changes[np.diff(np.append(changes, len(data))) >= LONG_RUN]
    ends = np.append(changes[1:], len(data))[np.diff(np.append(changes, len(data))) >= LONG_RUN]
    found = np.zeros(len(starts) + 1, np.int64)
    np.add.at(found, np.searchsorted(starts, long, "right") - 1, 1)
    np.add.at(found, np.searchsorted(starts, ends, "left"), -1)
    return np.cumsum(found[:-1]) > 0


class Tokenizers:
    """The two vocabularies: ids of texts, and the bytes of every id."""

    def __init__(self, vocabulary: str, ranks: str, model: str):
        import sentencepiece
        import tiktoken
        import tokenizers

        letters = byte_letters()
        with open(vocabulary, encoding="utf-8") as source:
            spec = json.load(source)
        names = {i: token for token, i in spec["model"]["vocab"].items()}
        names |= {t["id"]: None for t in spec["added_tokens"]}
        # Special tokens stand for no text.
        self.a_bytes = [bytes(letters[c] for c in names[i]) if names.get(i) else b"" for i in range(max(names) + 1)]
        with open(ranks, "rb") as source:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}
        if any(self.a_bytes[i] != token for token, i in known.items()):
            raise ValueError("the two files of the byte vocabulary differ")
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.steady = tokenizers.Tokenizer.from_file(vocabulary)
        self.steady.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.pieces.vocab_size()
        self.b_bytes = [
            bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace(BLANK, " ").encode()
            for i in range(size)
        ]
        self.a_lengths = np.array([len(token) for token in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(token) for token in self.b_bytes], np.int64)
        # Decimal ids with each separator, B's after A's.
        self.written = [f"{i}{mark}" for size in (len(self.a_bytes), size) for i in range(size) for mark in ("", ",", "|", ";")]

    def _byte_ids(self, text: str, long: bool) -> np.ndarray:
        if long:
            return np.array(self.steady.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers; none for texts that are empty or that a tokenizer does not give back."""
        raw = [b" " + text.encode() for text in texts]
        starts = np.cumsum([0, *map(len, raw)])[:-1]
        long = long_runs(np.frombuffer(b"".join(raw), np.uint8), starts) if raw else []
        a_bytes, b_bytes, none = self.a_bytes, self.b_bytes, np.empty(0, np.int64)
        a_ids, b_ids = [], []
        for text, data, is_long, found in zip(texts, raw, long, self.pieces.encode(texts, num_threads=1)):
            a, b = none, none
            if text and b"".join([b_bytes[i] for i in found]) == data:
                ids = self._byte_ids(" " + text, is_long)
                if b"".join([a_bytes[i] for i in ids.tolist()]) == data:
                    a, b = ids, np.array(found, np.int64)
            a_ids.append(a)
            b_ids.append(b)
        return a_ids, b_ids

    def aligned(self, texts: list[str]) -> Aligned:
        a_parts, b_parts = self.encoded(texts)
        a_at, b_at = (np.cumsum([0, *map(len, parts)]) for parts in (a_parts, b_parts))
        a_ids, b_ids = (np.concatenate([np.empty(0, np.int64), *parts]) for parts in (a_parts, b_parts))
        a_lengths, b_lengths = self.a_lengths[a_ids], self.b_lengths[b_ids]
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        # The token at every byte. Of the tokens that overlap one, that at its last byte reaches farthest.
        a_here, b_here = (np.repeat(np.arange(len(n), dtype=np.int64), n) for n in (a_lengths, b_lengths))
        last = a_here[b_ends - 1]
        ends_group = a_ends[last] == b_ends
        first = len(a_ids)
        succ = terminals(np.concatenate([first + b_here[a_ends - 1], np.where(ends_group, first + np.arange(len(b_ids)), last)]))
        number = np.cumsum(ends_group) - 1
        a_groups, b_groups = number[succ[:first] - first], number[succ[first:] - first]
        # Between two neighbouring ends of either lie one token of A and one of B.
        marks = np.zeros(len(a_here), bool)
        marks[a_ends - 1] = True
        marks[b_ends - 1] = True
        spots = np.flatnonzero(marks)
        a_links, b_links = a_here[spots], b_here[spots]
        return Aligned(
            a_ids, b_ids, a_at, b_at, a_groups, b_groups, np.append(0, np.cumsum(ends_group))[b_at], a_links, b_links,
            np.searchsorted(a_links, a_at),
        )

    def group_texts(self, found: Aligned) -> list[str]:
        """The groups of each text as text: ids of A, those of B behind a bar, groups divided by semicolons."""
        n_groups = int(found.group_at[-1])
        a_sizes, b_sizes = (np.bincount(groups, minlength=n_groups) for groups in (found.a_groups, found.b_groups))
        a_through, b_through = np.cumsum(a_sizes), np.cumsum(b_sizes)
        codes = np.empty(len(found.a_ids) + len(found.b_ids), np.int64)
        a_last, b_last = (np.append(groups[1:] != groups[:-1], True)[: len(groups)] for groups in (found.a_groups, found.b_groups))
        codes[np.arange(len(found.a_ids)) + (b_through - b_sizes)[found.a_groups]] = 4 * found.a_ids + np.where(a_last, 2, 1)
        marks = np.where(b_last, 3, 1)
        marks[found.b_at[1:][np.diff(found.b_at) > 0] - 1] = 0
        codes[np.arange(len(found.b_ids)) + a_through[found.b_groups]] = 4 * (found.b_ids + len(self.a_bytes)) + marks
        written = self.written
        parts = [written[code] for code in codes.tolist()]
        at = (found.a_at + found.b_at).tolist()
        return ["".join(parts[start:end]) for start, end in zip(at, at[1:])]


@lru_cache(maxsize=2)
def tokenizers_of(vocabulary: str, ranks: str, model: str) -> Tokenizers:
    """One per worker process and pair of vocabularies."""
    return Tokenizers(vocabulary, ranks, model)


def _parts(batch: pa.RecordBatch):
    """Rows of a batch in groups of bounded text."""
    texts = [text or "" for text in batch.column("text").to_pylist()]
    start, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size > GROUP_BYTES or end == len(texts):
            yield batch.slice(start, end - start), texts[start:end]
            start, size = end, 0


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def groups(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, ranks: str = BYTE_RANKS, model: str = PIECE_MODEL) -> DataFrame:
    """The ids of both tokenizers and the group of every token, numbered from 0 in each document."""
    ship(docs.sparkSession)

    def run(batches):
        both = tokenizers_of(vocabulary, ranks, model)
        for batch in batches:
            for rows, texts in _parts(batch):
                found = both.aligned(texts)
                a_groups = found.a_groups - np.repeat(found.group_at[:-1], np.diff(found.a_at))
                b_groups = found.b_groups - np.repeat(found.group_at[:-1], np.diff(found.b_at))
                columns = [
                    rows.column("doc_id"), _lists(found.a_ids, found.a_at), _lists(found.b_ids, found.b_at),
                    _lists(a_groups, found.a_at), _lists(b_groups, found.b_at),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "a_groups", "b_groups"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, GROUPS)


def links(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, ranks: str = BYTE_RANKS, model: str = PIECE_MODEL) -> DataFrame:
    """Sizes and digest of the groups of every document, and its distinct links with how often each occurs.

    A pair has the id of A in its upper and that of B in its lower half. ``row`` tells rows of one id apart.
    """
    ship(docs.sparkSession)

    def run(batches):
        both = tokenizers_of(vocabulary, ranks, model)
        span = len(both.a_bytes) * len(both.b_bytes)
        for batch in batches:
            for rows, texts in _parts(batch):
                found = both.aligned(texts)
                owners = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(found.link_at))
                flat = found.a_ids[found.a_links] * len(both.b_bytes) + found.b_ids[found.b_links]
                distinct, times = np.unique(owners * span + flat, return_counts=True)
                at = np.searchsorted(distinct, np.arange(len(texts) + 1, dtype=np.int64) * span)
                a, b = np.divmod(distinct % span, len(both.b_bytes))
                pairs = pa.StructArray.from_arrays([pa.array(a << 32 | b), pa.array(times.astype(np.int32))], names=["pair", "times"])
                digests = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in both.group_texts(found)]
                sizes = [pa.array(np.diff(at_)) for at_ in (found.a_at, found.b_at, found.group_at, found.link_at)]
                columns = [
                    rows.column("row"), rows.column("doc_id"), *sizes, pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs),
                ]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, LINKS)


def pair_counts(found: DataFrame) -> DataFrame:
    """Documents that hold each pair, and whether no other pair of its id of A is held by more."""
    counts = stored(found.select(F.inline("links")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.shiftright("pair", 32).alias("a")
    # One row for each id of A: at most the size of the vocabulary.
    highest = counts.groupBy(a).agg(F.max("n").alias("highest"))
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def least_frequent(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` pairs have it or more; classes of counts are compared."""
    kind = F.floor(F.log2("n") * CLASSES).cast("int").alias("kind")
    # At most CLASSES * 63 rows.
    sizes = sorted(((r["kind"], r["least"], r["pairs"]) for r in counts.groupBy(kind).agg(F.min("n").alias("least"), F.count("*").alias("pairs")).collect()), reverse=True)
    total, least = 0, 2**62
    for _, n, pairs in sizes:
        total += pairs
        if total > most:
            break
        least = n
    return least


def with_counts(found: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The stored rows of :func:`links` with the number of best links and the sum of all links' counts."""
    counts = stored(pair_counts(found), "pair-counts")
    least = least_frequent(counts, most)
    held = found.select("row", F.inline("links"))
    # At most ``most`` rows, by the choice of ``least``.
    met = held.join(F.broadcast(counts.filter(F.col("n") >= least)), "pair", "left")
    rest = met.filter("n is null").select("row", "pair", "times").join(counts.filter(F.col("n") < least), "pair")
    times = F.col("times").cast("long")
    sums = [F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum")]
    parts = [part.groupBy("row").agg(*sums) for part in (met.filter("n is not null"), rest)]
    totals = parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = found.drop("links").join(totals, "row", "left").drop("row")
    return rows.withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name in ("n_best", "count_sum")})


def aligned(docs: DataFrame, **files: str) -> DataFrame:
    """For every document the sizes and digest of its groups, and how its links agree with the corpus."""
    return with_counts(stored(links(docs, **files), "links"))
