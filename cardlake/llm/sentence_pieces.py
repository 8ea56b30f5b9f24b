"""SentencePiece encoding by vectorised merge rounds, and decoding.

A text becomes words that no piece crosses. The new words of a batch are merged together: flat arrays hold their
symbols, each round finds the best pair of every word by a segmented minimum over pair ranks, merges its occurrences
from the left at once, and compacts the arrays, until no pair is left. Finished words drop out of the arrays.

The library merges the best pair first and, of equal ones, the leftmost; a pair that a merge creates is considered at
once. Merging all occurrences of a pair together gives the same as long as no merge makes a better or equal pair, which
holds for trained merges. The rounds watch for it: a word whose best rank does not rise is done again with one merge a
round, as are the pairs of runs of blanks, whose pieces share one score.

Null and empty texts have no ids and decode to empty text. Texts of any length are encoded whole; rows that repeat are
encoded one by one; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import ship

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
NEVER = np.int64(2**62)
ENCODED = "doc_id bigint, ids array<int>"
# Limits of the cache of words, of which only common ones stay beyond them, and of work; results do not depend on them.
CACHED, CACHED_LENGTH = 400_000, 64
BATCH_IDS = 250_000


class PieceModel:
    """The vocabulary of a BPE model with byte fallback and the identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        pieces = [library.id_to_piece(i) for i in range(size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(size)]
        self.unknown = library.unk_id()
        self.bytes = np.full(256, self.unknown, np.int64)
        for i in range(size):
            if library.is_byte(i):
                self.bytes[int(pieces[i][3:5], 16)] = i
        if library.normalize("  x  y ") != f"{BLANK * 3}x{BLANK * 2}y{BLANK}" or library.normalize("①ﬁ") != f"{BLANK}①ﬁ":
            raise ValueError("this model normalises texts")
        self.ids = {piece: i for i, piece in enumerate(pieces) if not special[i]}
        normal = sorted(self.ids, key=lambda piece: (-library.get_score(self.ids[piece]), self.ids[piece]))
        scores = {piece: library.get_score(self.ids[piece]) for piece in normal}
        # Symbols are pieces and, beyond the vocabulary's size, single characters without a piece.
        self.size = size
        rank, ranks, last = -1, {}, None
        for piece in normal:
            if scores[piece] != last:
                rank, last = rank + 1, scores[piece]
            ranks[piece] = rank
        longer = [piece for piece in normal if len(piece) > 1]
        shared: dict[int, int] = {}
        for piece in longer:
            shared[ranks[piece]] = shared.get(ranks[piece], 0) + 1
        self.shared = np.zeros(rank + 2, bool)
        for value, pieces_of_rank in shared.items():
            self.shared[value] = pieces_of_rank > 1
        # Every way to make a piece of two symbols, as one sorted array of keys.
        keys, made, order = [], [], []
        for piece in longer:
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    made.append(self.ids[piece])
                    order.append(ranks[piece])
        at = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[at], NEVER)
        self.made = np.append(np.array(made, np.int64)[at], 0)
        self.order = np.append(np.array(order, np.int64)[at], NEVER)
        if any(BLANK in piece.lstrip(BLANK) for piece in longer) or any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in longer):
            raise ValueError("a piece crosses the border of words")
        # Characters of no longer piece stand alone; runs of blanks give whole pieces of the longest length from the left.
        joined = set("".join(longer))
        self.run = max((len(p) for p in longer if not p.strip(BLANK)), default=1)
        inside = "".join(sorted(c for c in map(chr, range(1, 0x3000)) if c not in joined and not c.isalnum()))
        alone = re.escape(inside)
        runs = f"{BLANK}{{{self.run}}}(?={BLANK}{BLANK})|" if self.run > 1 else ""
        self.words = re.compile(f"{runs}{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|[{alone}]")
        self.known: dict[str, bytes] = {}
        self.text = [b""] * size
        for i in range(size):
            if library.is_byte(i):
                self.text[i] = bytes([int(pieces[i][3:5], 16)])
            elif not library.is_control(i):
                self.text[i] = pieces[i].replace(BLANK, " ").encode()
        self.text[self.unknown] = " ⁇ ".encode()
        self.drops_blank = np.array([piece.startswith(BLANK) for piece in pieces])

    def _symbol(self, piece: str) -> int | None:
        """The id of a piece; single characters without one have ids beyond the vocabulary."""
        found = self.ids.get(piece)
        return found if found is not None else self.size + ord(piece) if len(piece) == 1 else None

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        flat = [self._symbol(c) for word in words for c in word]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.array(flat, np.int64)
        done: list[np.ndarray | None] = [None] * len(words)
        again = self._rounds(symbols, lengths, done, single=False)
        if len(again):
            parts = [symbols[s : s + n] for s, n in zip((np.cumsum(lengths) - lengths)[again], lengths[again])]
            redone: list[np.ndarray | None] = [None] * len(again)
            self._rounds(np.concatenate(parts), lengths[again], redone, single=True)
            for word, ids in zip(again, redone):
                done[word] = ids
        return [self._fallback(ids) for ids in done]

    def _rounds(self, symbols: np.ndarray, lengths: np.ndarray, done: list, single: bool) -> np.ndarray:
        """Merge until no pair is left. Returns the words whose best rank did not rise from round to round."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        last = np.full(len(lengths), -1, np.int64)
        odd = []
        while len(symbols):
            # Ranks of the pairs; a word's last symbol starts none.
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.searchsorted(self.keys, pair)
            rank = np.full(len(symbols), NEVER)
            hit = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank[:-1][hit] = self.order[at[hit]]
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            words = owner[starts]
            finished = best == NEVER
            if not single:
                fallen = ~finished & (best <= last[words])
                # Ranks that several pieces share merge one by one, so may repeat.
                fallen &= ~(self.shared[np.minimum(best, len(self.shared) - 1)] & (best == last[words]))
                odd += words[fallen].tolist()
                finished |= fallen
            for i in np.flatnonzero(finished):
                done[words[i]] = symbols[starts[i] : starts[i] + sizes[i]]
            last[words] = best
            wide = np.repeat(best, sizes)
            chosen = (rank == wide) & (rank < NEVER)
            # Of overlapping occurrences every second one, from the left; with shared ranks only the first.
            spots = np.flatnonzero(chosen)
            if len(spots):
                run = np.append(True, (np.diff(spots) != 1) | (owner[spots[1:]] != owner[spots[:-1]]))
                first = np.maximum.accumulate(np.where(run, np.arange(len(spots)), 0))
                keep = (np.arange(len(spots)) - first) % 2 == 0
                lone = self.shared[rank[spots]] | single
                new_word = np.append(True, owner[spots[1:]] != owner[spots[:-1]])
                keep &= ~lone | new_word
                spots = spots[keep]
                symbols = symbols.copy()
                symbols[spots] = self.made[at[spots]]
            left = ~np.repeat(finished, sizes)
            left[spots + 1] = False
            symbols, owner = symbols[left], owner[left]
        return np.array(odd, np.int64)

    def _fallback(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece as the bytes of their UTF-8."""
        if not (ids >= self.size).any():
            return ids.astype(np.int32)
        found: list[int] = []
        for i in ids.tolist():
            if i < self.size:
                found.append(i)
            else:
                found += self.bytes[np.frombuffer(chr(i - self.size).encode(), np.uint8)].tolist()
        return np.array(found, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. New words of all texts are merged together."""
        split = [self.words.findall(BLANK + text.replace(" ", BLANK)) if text else [] for text in texts]
        known = self.known
        if len(known) > CACHED:
            # Words of this group are common ones; all others are forgotten.
            known = self.known = {word: known[word] for words in split for word in words if word in known}
        new = {word for words in split for word in words if word not in known}
        passing: dict[str, bytes] = {}
        if new:
            listed = list(new)
            for word, ids in zip(listed, self.merged(listed)):
                (known if len(word) <= CACHED_LENGTH else passing)[word] = ids.tobytes()
        if passing:
            found = (b"".join([known[w] if w in known else passing[w] for w in words]) for words in split)
        else:
            found = (b"".join([known[w] for w in words]) for words in split)
        return [np.frombuffer(ids, np.int32) for ids in found]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces with blanks, runs of byte pieces as UTF-8; the blank that encoding puts first is taken off."""
        if not len(ids):
            return ""
        text = self.text
        data = b"".join([text[i] for i in ids.tolist()])
        if self.drops_blank[ids[0]]:
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per worker process and model."""
    return PieceModel(path)


def _parts(ids: list, texts: list[str]):
    """Rows in groups of bounded text."""
    start, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size > BATCH_IDS:
            yield ids[start:end], texts[start:end]
            start, size = end, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the ids of every whole text, without begin and end ids."""
    ship(docs.sparkSession)

    def run(batches):
        pieces = piece_model(model)
        try:
            for batch in batches:
                texts = [text or "" for text in batch.column("text").to_pylist()]
                for doc_ids, part in _parts(batch.column("doc_id").to_pylist(), texts):
                    found = pieces.encode(part)
                    offsets = np.append(0, np.cumsum([len(ids) for ids in found])).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], names=["doc_id", "ids"])
        finally:
            # The worker goes on to other tasks, and must not hold the words beside theirs.
            pieces.known.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""
    ship(encoded.sparkSession)

    def run(batches):
        pieces = piece_model(model)
        for batch in batches:
            column = batch.column("ids")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            texts = [pieces.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, ENCODED + ", decoded string")
