"""Byte-level BPE by dynamic programming over prefixes, for one text inside a task.

A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours are: merging the bytes of a
neighbouring pair gives that pair back. So the encoding of a prefix is the encoding of a shorter prefix and one last
token, and there is only one last token that fits the last token before it. Each prefix costs a few lookups, and the
counts of all prefixes come from one pass.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

# Fixed value: the pattern that splits text before the merges of a GPT-2 style vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as that pattern has it.
BLANK = "\t-\r \x85\xa0  -     　"
BLANKS = "".join(chr(c) for c in range(0x3001) if re.match(f"[{BLANK}]", chr(c)))
CHUNK = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
NEVER = 1 << 60
# Limits of caches; results do not depend on them.
CACHED, CACHED_LENGTH = 200_000, 64


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable bytes stand for themselves, others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Recent:
    """A cache in two generations: when the young one is full it becomes the old one; what is used stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = value


class PrefixTokenizer:
    def __init__(self, path: str):
        letters = byte_letters()
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens = {i: token for token, i in self.ids.items()}
        self.lengths = {i: len(token) for i, token in self.tokens.items()}
        self.endings = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in self.ids.items():
            self.endings.add_word(token.decode("latin-1"), i)
        self.endings.make_automaton()
        self._split = regex.compile(PATTERN)
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or "(?!)")
        self._fits: dict[int, bool] = {}
        self._last_merge: dict[bytes, tuple[int, bytes, bytes]] = {}
        self._deltas, self._words = Recent(CACHED), Recent(CACHED)

    def _formed(self, token: bytes) -> tuple[int, bytes, bytes]:
        """The last merge that makes a token of its bytes: rank, left and right part. A single byte has rank -1.

        A token that its own bytes do not merge to has no parts: it occurs in no encoding.
        """
        known = self._last_merge.get(token)
        if known is not None:
            return known
        parts = [token[i : i + 1] for i in range(len(token))]
        last = (-1, b"", b"")
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                last = (NEVER, b"", b"")
                break
            last = (rank, parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self._last_merge[token] = last
        return last

    def _fit(self, before: int, token: int) -> bool:
        """Whether the bytes of two tokens merge to these two again; ``before`` is -1 at the beginning.

        Follows the two symbols beside the border back in time, from the whole tokens to single bytes. They fit if
        at no time the pair at the border had a lower rank than the next merge that uses up one of its symbols.
        """
        right = self.tokens[token]
        right_form = self._formed(right)
        if before < 0:
            return right_form[0] < NEVER
        left, next_left, next_right = self.tokens[before], NEVER, NEVER
        left_form = self._formed(left)
        if left_form[0] == NEVER or right_form[0] == NEVER:
            return False
        while True:
            border = self.ranks.get((left, right), NEVER)
            # At equal ranks the pair further left merges first.
            if border < next_left and border <= next_right and border < NEVER:
                return False
            if left_form[0] < 0 and right_form[0] < 0:
                return True
            if right_form[0] >= left_form[0]:
                next_right, right = right_form[0], right_form[1]
                right_form = self._formed(right)
            else:
                next_left, left = left_form[0], left_form[2]
                left_form = self._formed(left)

    def prefixes(self, data: bytes) -> tuple[list[int], list[int]]:
        """For every prefix of a pre-token: the number of its tokens, and the last of them.

        The automaton gives the tokens that end at each byte, the longest first.
        """
        counts, lasts, lengths, fits = [0] * (len(data) + 1), [-1] * (len(data) + 1), self.lengths, self._fits
        done = 0
        for end, token in self.endings.iter(data.decode("latin-1")):
            if end < done:
                continue
            start = end + 1 - lengths[token]
            key = lasts[start] << 32 | token
            fit = fits.get(key)
            if fit is None:
                if len(fits) > 4 * CACHED:
                    fits.clear()
                fit = fits[key] = self._fit(lasts[start], token)
            if fit:
                done = end + 1
                counts[done], lasts[done] = counts[start] + 1, token
        return counts, lasts

    def _word_deltas(self, word: str) -> bytes:
        """The deltas of a pre-token's prefixes, by code points."""
        known = self._words.get(word)
        if known is None:
            data = word.encode()
            counts, _ = self.prefixes(data)
            if len(data) > len(word):
                ends = np.cumsum([0, *(len(c.encode()) for c in word)])
                counts = [counts[i] for i in ends]
            elif word in ("'re", "'ve", "'ll"):  # cut short, these are an apostrophe and a letter
                counts[2] = 2
            known = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])
            if len(word) <= CACHED_LENGTH:
                self._words.put(word, known)
        return known

    def _chunk_deltas(self, chunk: str) -> bytes:
        """The deltas of a chunk: white space and what follows it up to the next white space.

        No token crosses its ends. A prefix that ends in the white space has it as one pre-token, longer prefixes
        have its last character apart.
        """
        known = self._deltas.get(chunk)
        if known is None:
            known = b"".join([self._word_deltas(word) for word in self._split.findall(chunk)])
            bare = chunk.lstrip(BLANKS)
            width = len(chunk) - len(bare)
            if bare and width > 1:
                blank = self._word_deltas(chunk[:width])
                signed = lambda deltas: sum(b - 256 if b > 127 else b for b in deltas)
                behind = signed(known[: width + 1]) - signed(blank)
                known = blank + bytes([behind & 255]) + known[width + 1 :]
            if len(chunk) <= CACHED_LENGTH:
                self._deltas.put(chunk, known)
        return known

    def _plain_deltas(self, text: str) -> bytes:
        deltas, young = self._chunk_deltas, self._deltas.young
        return b"".join([young.get(c) or deltas(c) for c in CHUNK.findall(text)])

    def deltas(self, text: str) -> bytes:
        """One signed byte for each code point: the tokens of the prefix that ends there, less those of the one before."""
        if not self._special.search(text):
            return self._plain_deltas(text)
        parts, at = [], 0
        for found in self._special.finditer(text):
            # Inside a special string the prefix is still plain text; at its end it is one token.
            special = found.group()
            part = self._plain_deltas(text[at : found.start()] + special[:-1])
            inside = sum(b - 256 if b > 127 else b for b in part[found.start() - at :])
            parts += [part, bytes([(1 - inside) & 255])]
            at = found.end()
        return b"".join([*parts, self._plain_deltas(text[at:])])

    def count(self, text: str) -> int:
        found = self.deltas(text)
        return sum(found) - 256 * sum(1 for b in found if b > 127) if found else 0

    def _chunk_ids(self, chunk: str) -> list[int]:
        found: list[int] = []
        for word in self._split.findall(chunk):
            data = word.encode()
            _, lasts = self.prefixes(data)
            own, end = [], len(data)
            while end:
                own.append(lasts[end])
                end -= self.lengths[lasts[end]]
            found += reversed(own)
        return found

    def encode(self, text: str) -> list[int]:
        """All ids of a text; special strings inside it are special tokens."""
        found: list[int] = []
        at = 0
        for special in self._special.finditer(text):
            for chunk in CHUNK.findall(text[at : special.start()]):
                found.extend(self._chunk_ids(chunk))
            found.append(self.specials[special.group()])
            at = special.end()
        for chunk in CHUNK.findall(text[at:] if at else text):
            found.extend(self._chunk_ids(chunk))
        return found


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PrefixTokenizer:
    """One per worker process and vocabulary."""
    return PrefixTokenizer(path)
