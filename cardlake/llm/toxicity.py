"""Toxicity of texts, scored after a noisy-channel restoration of obfuscated words.

A character language model is counted over all documents: trigrams of folded letters, 28 classes, so that it has a
bounded size at any size of the corpus. A token that mixes letters with digits or symbols, draws letters out, or is
spelled with blanks or dots between letters becomes a lattice: each character stands for itself, for the letters that
it imitates, for a repetition or for nothing. The likeliest path under the language model and the channel is the
restored word. Other tokens have one path, themselves.

A separator between two letters, blanks among them, is a border of words or was put there to hide a word. The language
model says which is likelier, given the letters on both sides and what the channel takes for each character that it puts
in; this is decided for all separators of many texts at once, at any length of the parts. Words whose separators are
dropped are read beside the tokens as they stand.

The score looks at character n-grams of restored words, so that unseen endings of a known stem count. How much more
often an n-gram occurs in toxic documents, less twice its standard error, is its weight. A word weighs as much as its
best n-gram, and a logistic regression over a document's heaviest words gives the score. It is fitted on weights that
come from other folds of the labelled documents. Labels beyond ``MAX_LABELLED`` documents, taken by a hash of the id,
are not used for fitting; the language model and the scores cover everything.

Null and empty texts have no words; they get the score of a document without heavy words. Rows that repeat are scored
one by one, extra columns are carried by :func:`scored`. Of several labels of one document the mean decides. Without
usable labels every score is 0. Texts of any length are scored whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from operator import methodcaller

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import ship, stored, text_of
from cardlake.llm.sketches import mixed

THRESHOLD = 0.3
MAX_LABELLED = 20_000
# Hashes of n-grams; the tables of weights have so many entries at any size of the input.
FEATURES = 2**20
FOLDS = 3
CLASSES = 28  # 0: border, 1 to 26: letters, 27: other letters
OTHER = 27
# What a character may imitate (fixed values).
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "*": "aeiou",
}
# Log probabilities of the channel.
IMITATED, DROPPED, DROPPED_LETTER, REPEATED, UNCHANGED = -1.2, -1.2, -12.0, -1.6, -0.1
# Log odds of a blank, and of another separator, that was put into a word, beside what the language model says.
DROPPED_BLANK, DROPPED_MARK = 1.5, 4.0
# Limits of work and of a cache; results do not depend on them.
GROUP_CHARS, CACHED, LONGEST_CACHED = 100_000, 200_000, 64
_EDGES = re.compile(r"^[^\w$@!|(<€£¡*]+|[^\w$@+*|]+$")
_PLAIN = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")
# Marks that imitate no letter.
_MARKS = ".,;:?\"'"
_STRIPPED = methodcaller("strip", _MARKS)


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """The class of every code point: accents are taken off."""
    classes = np.zeros(0x110000, np.uint8)
    for code in range(0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if "a" <= base <= "z":
            classes[code] = ord(base) - 96
        elif chr(code).isalpha():
            classes[code] = OTHER
    for code in (*range(0x250, 0x2000), *range(0x2C00, 0xD800), *range(0xF900, 0xFE00)):
        if chr(code).isalpha():
            classes[code] = OTHER
    return classes


_ENDS, _BLANK, _LIKE = 32, 64, 128


@lru_cache(maxsize=1)
def stream_kinds() -> np.ndarray:
    """One byte for every code point: the class of a letter, or of the letter that a digit or sign imitates (_LIKE), whether
    it ends words (_ENDS), and whether it is a blank (_BLANK)."""
    kinds = letter_classes().copy()
    kinds[[0, *(code for code in range(0x3000) if chr(code).isdigit())]] |= _ENDS
    for char, letters in IMITATES.items():
        like = _LIKE + ord(letters[0]) - 96 if char.isdigit() or char in "@$€£" else 0
        kinds[ord(char)] |= _ENDS | like
    kinds[[code for code in range(0x3001) if chr(code).isspace()]] |= _BLANK
    return kinds


def _trigrams(batches):
    """Counts of letter trigrams; a word begins after two borders and ends with one."""
    classes, totals = letter_classes(), np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            found = classes[np.frombuffer((" " + (text.as_py() or "") + " ").encode("utf-32-le"), np.uint32)].astype(np.int32)
            middle, last = np.append(0, found[:-1]), found
            first = np.where(middle == 0, 0, np.append([0, 0], found[:-2])[: len(found)])
            seen = (middle > 0) | (last > 0)
            totals += np.bincount(((first * CLASSES + middle) * CLASSES + last)[seen], minlength=CLASSES**3)
    rows = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(totals[rows])], names=["trigram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two letters, from all texts: interpolated trigrams, bigrams and unigrams."""
    ship(docs.sparkSession)
    counted = docs.select(text_of("text").alias("text")).mapInArrow(_trigrams, "trigram int, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))
    # At most CLASSES ** 3 rows.
    rows = counted.toPandas()
    counts = np.zeros(CLASSES**3)
    counts[rows["trigram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    share = lambda table: table / np.maximum(table.sum(-1, keepdims=True), 1)
    return np.log(0.89 * share(tri) + 0.1 * share(bi) + 0.009 * share(uni) + 0.001 / CLASSES)


class Restorer:
    """Restored words of tokens, under a character language model."""

    def __init__(self, model: np.ndarray):
        self.model, self.steps = model.ravel().tolist(), {}

    def _options(self, char: str, before: str) -> list[tuple[str, float]]:
        if _LETTER.match(char):
            same = [("", REPEATED)] if char == before else []
            return [(char, UNCHANGED), *same]
        letters = IMITATES.get(char, "")
        options = [(c, IMITATED) for c in letters]
        if char == before:
            options.append(("", REPEATED))
        options.append(("", DROPPED_LETTER if letters else DROPPED))
        return options

    def _step(self, char: str, same: bool) -> list[tuple[str, float, int]]:
        """The options of a character with the class of each letter, kept for the common characters."""
        classes = letter_classes()
        step = [(c, cost, int(classes[ord(c)]) if c else 0) for c, cost in self._options(char, char if same else "")]
        if char < "\u0250":
            self.steps[char, same] = step
        return step

    def best_path(self, token: str) -> str:
        """The likeliest letters behind a token: Viterbi over the last two letters, a * CLASSES + b."""
        model, steps = self.model, self.steps
        states = {0: (0.0, None)}
        before = ""
        for char in token.lower():
            after: dict[int, tuple] = {}
            same = char == before
            step = steps.get((char, same)) or self._step(char, same)
            for state, (score, path) in states.items():
                row, last = state * CLASSES, state % CLASSES * CLASSES
                for letter, cost, c in step:
                    if letter:
                        total, reached = score + cost + model[row + c], last + c
                        known = after.get(reached)
                        if known is None or known[0] < total:
                            after[reached] = (total, (path, letter))
                    else:
                        total, known = score + cost, after.get(state)
                        if known is None or known[0] < total:
                            after[state] = (total, path)
            states, before = after, char
        _, path = max(((score + model[state * CLASSES], path) for state, (score, path) in states.items()), key=lambda s: s[0])
        letters = []
        while path is not None:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def words(self, token: str) -> list[str]:
        """The words of a token, restored if it looks obfuscated."""
        if token.isalpha() and not _DRAWN.search(token):
            return [token.lower()]
        core = _EDGES.sub("", token)
        parts = _PLAIN.findall(core)
        if not parts:
            return []
        drawn = _DRAWN.search(core)
        if len(parts) == 1 and len(parts[0]) == len(core) and not drawn:
            return [core.lower()]
        spelled = len(parts) > 2 and all(len(p) == 1 for p in parts)
        mixed = any(c in IMITATES for c in core)
        if not (drawn or spelled or mixed):
            # Without a blank both readings are kept: the parts, and the word without its separators.
            return [*(p.lower() for p in parts), "".join(parts).lower()]
        restored = self.best_path(core)
        return [restored] if restored else []


_SALTS = mixed(np.arange(16, dtype=np.uint64) + np.uint64(77))
_POWER = np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams, word after word, and how many each word has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return ngrams_of(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), lengths)


def ngrams_of(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words that lie one after the other.

    A word of three letters or more has itself, its beginnings and ends of four to six letters where it is longer, and
    all runs of five.
    """
    letters = codes.astype(np.uint64)
    if not len(letters):
        return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    letters = mixed(letters + _SALTS[0])
    word_of = np.repeat(np.arange(len(lengths)), lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _POWER, np.uint64))
    weighed = letters * powers[np.arange(len(letters)) - np.repeat(starts, lengths)]
    long_enough = np.flatnonzero(lengths >= 3)
    sums = np.append(np.uint64(0), np.cumsum(weighed))
    found = [mixed((sums[ends] - sums[starts])[long_enough] + _SALTS[1])]
    owners = [long_enough]
    for n in (4, 5, 6):
        windows = max(0, len(letters) - n + 1)
        rolled = np.zeros(windows, np.uint64)
        for j in range(n):
            rolled += letters[j : j + windows] * powers[j] if j < len(powers) else np.uint64(0)
        longer = np.flatnonzero(lengths > n)
        found += [mixed(rolled[starts[longer]] + _SALTS[n]), mixed(rolled[ends[longer] - n] + _SALTS[n + 4])]
        owners += [longer, longer]
        if n == 5 and windows:
            inside = np.flatnonzero(word_of[:windows] == word_of[n - 1 :])
            found.append(mixed(rolled[inside] + _SALTS[12]))
            owners.append(word_of[inside])
    owner, hashes = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return (hashes[order] & np.uint64(FEATURES - 1)).astype(np.int64), np.bincount(owner, minlength=len(lengths))


def tokens_of(text: str) -> set[str]:
    """The distinct tokens of a text in lower case, without the marks around them, and every run of single characters as one."""
    tokens = text.split()
    found = set(map(_STRIPPED, set(tokens)))
    single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
    if (single[:-2] & single[1:-1] & single[2:]).any():
        found.update("".join(run.group().split()) for run in _SPELLED.finditer(text))
    return found


class Joiner:
    """Words behind separators that the language model takes for dropped."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words, in lower case, whose letters are held apart, as they read without separators.

        The characters of all texts that may be letters, and of each word where it starts and ends among them and its text.
        """
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
        kinds, none = stream_kinds()[codes], np.empty(0, np.int64)
        # A single digit or sign beside a letter reads as the letter that it imitates.
        like = np.flatnonzero(kinds & _LIKE)
        class_of = np.where(kinds & _ENDS, 0, kinds & 31)
        if len(like):
            sides = np.concatenate([[0], kinds, [0]])
            before, after = sides[like], sides[like + 2]
            beside = (np.where(before & _ENDS, 0, before & 31) > 0) | (np.where(after & _ENDS, 0, after & 31) > 0)
            alone = like[((before | after) & _LIKE == 0) & beside]
            class_of[alone] = kinds[alone] & 31
        spots = np.flatnonzero(class_of)
        if len(spots) < 2:
            return codes[spots], none, none, none
        apart = np.diff(spots) > 1
        at = np.flatnonzero(apart)
        # Of the characters between two letters: how many there are, how many are blanks, whether one ends words.
        before, after = spots[at], spots[at + 1]
        n_blanks, n_ends = (np.append(0, np.cumsum(kinds & bit != 0, dtype=np.int32)) for bit in (_BLANK, _ENDS))
        inside = n_ends[after] == n_ends[before + 1]
        at, before, after = at[inside], before[inside], after[inside]
        n_blank = n_blanks[after] - n_blanks[before + 1]
        may_join = ~apart
        may_join[at] = True
        letters = np.concatenate([[0], class_of[spots], [0]]).astype(np.int64)
        # Letter at + 1 of ``letters`` stands before a separator; w and v lie beyond its neighbours y and u.
        w, y, u, v = letters[at], letters[at + 1], letters[at + 2], letters[np.minimum(at + 3, len(letters) - 1)]
        left, right = np.append(False, may_join)[at], np.append(may_join, False)[at + 1]
        near_left, near_right = left & ~np.append(True, apart)[at], right & ~np.append(apart, True)[at + 1]
        t = self.model
        joined = t[w * left, y, u] + t[y, u, v * right] + DROPPED_BLANK * n_blank + DROPPED_MARK * (after - before - 1 - n_blank)
        border = t[w * near_left, y, 0] + t[0, 0, u] + t[0, u, v * near_right]
        dropped = at[joined > border]
        linked = ~apart
        linked[dropped] = True
        borders = np.flatnonzero(~linked)
        word = np.unique(np.searchsorted(borders, dropped))
        starts, stops = np.append(0, borders + 1)[word], np.append(borders, len(spots) - 1)[word] + 1
        owner = np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), spots[starts], "right")
        return codes[spots], starts, stops, owner

    def words(self, texts: list[str]) -> list[list[str]]:
        """The same as text, for each text."""
        codes, starts, stops, owner = self.spans(texts)
        found: list[list[str]] = [[] for _ in texts]
        for text, start, stop in zip(owner.tolist(), starts.tolist(), stops.tolist()):
            found[text].append(codes[start:stop].tobytes().decode("utf-32-le"))
        return found


class Reader:
    """What the words of texts give, worked out for all new ones of a group of texts together."""

    def __init__(self, model: np.ndarray, value):
        """``value`` turns the hashes of all tokens, and how many each has, into one value per token."""
        self.restorer, self.joiner, self.value, self.known = Restorer(model), Joiner(model), value, {}

    def read(self, texts: list[str]):
        """For each text the values of its distinct tokens, and of its words with dropped separators."""
        for start, end in groups(texts):
            lowered = [text.lower() for text in texts[start:end]]
            split = [tokens_of(text) for text in lowered]
            codes, starts, stops, owner = self.joiner.spans(lowered)
            sizes = stops - starts
            # The characters of all words, one after the other.
            chosen = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            plain = np.add.reduceat(letter_classes()[codes[chosen]] == 0, np.cumsum(sizes) - sizes) == 0 if len(sizes) else np.empty(0, bool)
            for word in np.flatnonzero(~plain).tolist():
                # A word with digits or signs is one more token, to be restored.
                split[owner[word]].add(codes[starts[word] : stops[word]].tobytes().decode("utf-32-le"))
            value_of = self._values(set().union(*split)).__getitem__
            # Nearly every other word is new, so none is kept.
            kept = np.repeat(plain, sizes)
            more = self.value(*ngrams_of(codes[chosen[kept]], sizes[plain]))
            places = np.searchsorted(owner[plain], np.arange(len(split) + 1)).tolist()
            for tokens, first, last in zip(split, places, places[1:]):
                yield [*map(value_of, tokens), *more[first:last]]

    def _values(self, tokens: set[str]) -> dict:
        """A dictionary with the values of ``tokens``, and of others that were read before."""
        known = self.known
        new = list(tokens.difference(known))
        if len(known) + len(new) > CACHED:
            # Words of this group are common ones; all others are forgotten.
            known = self.known = {token: known[token] for token in tokens.intersection(known)}
        read = self.restorer.words
        words = [(token,) if token.isalpha() and not _DRAWN.search(token) else read(token) for token in new]
        hashes, counts = ngrams([word for some in words for word in some])
        sums = np.append(0, np.cumsum(counts))
        ends = np.cumsum([len(some) for some in words], dtype=np.int64) if words else np.empty(0, np.int64)
        found = dict(zip(new, self.value(hashes, np.diff(np.append(0, sums[ends])))))
        if max(map(len, new), default=0) > LONGEST_CACHED:
            known.update(item for item in found.items() if len(item[0]) <= LONGEST_CACHED)
            return {token: known[token] if token in known else found[token] for token in tokens}
        known.update(found)
        return known


def _bytes_of(hashes: np.ndarray, per_token: np.ndarray) -> list[bytes]:
    """The hashes of each token, apart from those of the others."""
    flat, ends = hashes.astype(np.int32).tobytes(), 4 * np.cumsum(per_token)
    return [flat[start:end] for start, end in zip((ends - 4 * per_token).tolist(), ends.tolist())]


def groups(texts: list[str]):
    """Ranges of texts with a bounded number of characters each."""
    start, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= GROUP_CHARS or end == len(texts):
            yield start, end
            start, size = end, 0


def _weights(positive: np.ndarray, negative: np.ndarray, n_positive: float, n_negative: float) -> np.ndarray:
    """Log odds that an n-gram adds, less two standard errors; never below 0."""
    gain = np.log((positive + 0.5) / (n_positive + 1)) - np.log((negative + 0.5) / (n_negative + 1))
    error = np.sqrt(1 / (positive + 0.5) + 1 / (negative + 0.5))
    return np.maximum(gain - 2 * error, 0).astype(np.float32)


def summary(weights: list[float]) -> list[float]:
    """What the regression sees of the weights of a document's words."""
    # No weight is below 0.
    heavy = sorted(filter(None, weights), reverse=True)
    top = [*heavy[:3], 0.0, 0.0, 0.0]
    strong = sum(1 for w in heavy if w > 1)
    return [top[0], top[1], top[2], min(sum(heavy[:10]), 60.0), float(np.log1p(strong)), strong / max(len(weights), 1)]


def heaviest(weights: np.ndarray, hashes: np.ndarray, per_token: np.ndarray) -> list[float]:
    """The weight of each token: that of its best n-gram."""
    found = np.zeros(len(per_token))
    some = np.flatnonzero(per_token)
    if len(some):
        starts = np.cumsum(per_token) - per_token
        found[some] = np.maximum.reduceat(weights[hashes], starts[some])
    return found.tolist()


class Scorer:
    """Summaries of documents under one table of weights."""

    def __init__(self, model: np.ndarray, weights: np.ndarray):
        self.reader = Reader(model, lambda hashes, per_token: heaviest(weights, hashes, per_token))

    def summaries(self, texts: list[str]) -> np.ndarray:
        rows = [summary(weights) for weights in self.reader.read(texts)]
        return np.array(rows).reshape(len(rows), 6)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, constant last, by Newton's method with a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b)), slope)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Classifier:
    """The fitted model: a language model, weights of n-grams, and the regression. ``score`` is from 0 to 1."""

    def __init__(self, model: np.ndarray, weights: np.ndarray, coefficients: np.ndarray | None):
        self.model, self.weights, self.coefficients, self.scorer = model, weights, coefficients, None

    def __getstate__(self):
        return {**self.__dict__, "scorer": None}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(texts))
        if self.scorer is None:
            self.scorer = Scorer(self.model, self.weights)
        z = self.scorer.summaries(texts) @ self.coefficients[:-1] + self.coefficients[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text or ""])[0])


def bucket(doc_id: str = "doc_id"):
    """The remainder that decides which rows are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """fold, toxic and text of at most ``most`` labelled documents, those with the smallest hashes of their ids."""
    one = labels.filter("doc_id is not null and toxic is not null").filter(bucket() != 2).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    some = one.select(F.col("doc_id").alias("labelled_id"), "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "labelled_id").limit(most).drop("h")
    # Bounded by ``most`` rows of a few bytes.
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id"))
    return rows.select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "toxic", "text")


def _feature_counts(rows: DataFrame, model: np.ndarray) -> np.ndarray:
    """Documents with each hash, by fold and label: an array of FOLDS x 2 x FEATURES."""

    def count(batches):
        reader = Reader(model, _bytes_of)
        totals = np.zeros(FOLDS * 2 * FEATURES, np.int32)
        for batch in batches:
            folds, toxic, texts = (batch.column(c).to_pylist() for c in ("fold", "toxic", "text"))
            for fold, bad, parts in zip(folds, toxic, reader.read(texts)):
                totals[np.unique(np.frombuffer(b"".join(parts), np.int32)) + (fold * 2 + bad) * FEATURES] += 1
        spots = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(spots.astype(np.int32)), pa.array(totals[spots])], names=["spot", "n"])

    counted = rows.mapInArrow(count, "spot int, n int").groupBy("spot").agg(F.sum("n").alias("n"))
    # Only hashes that some toxic document has can weigh anything.
    of_hash = F.pmod(F.col("spot"), F.lit(FEATURES))
    wide = counted.groupBy(of_hash.alias("hash")).agg(
        *(F.sum(F.when(F.floor(F.col("spot") / FEATURES) == k, F.col("n")).otherwise(0)).cast("int").alias(f"n{k}") for k in range(2 * FOLDS))
    )
    found = wide.filter(sum(F.col(f"n{2 * f + 1}") for f in range(FOLDS)) > 1).toPandas()
    table = np.zeros((2 * FOLDS, FEATURES), np.int32)
    for k in range(2 * FOLDS):
        table[k, found["hash"].to_numpy(np.int64)] = found[f"n{k}"].to_numpy()
    return table.reshape(FOLDS, 2, FEATURES)


def _summaries(rows: DataFrame, model: np.ndarray, weights: list[np.ndarray]):
    """Label and summary of every labelled document, under the weights of the other folds."""

    def summarise(batches):
        # One reader for all folds: only the weights differ.
        reader = Reader(model, _bytes_of)
        for batch in batches:
            folds, toxic, texts = (batch.column(c).to_pylist() for c in ("fold", "toxic", "text"))
            found = []
            for fold, parts in zip(folds, reader.read(texts)):
                sizes = np.array([len(part) // 4 for part in parts], np.int64)
                found.append(summary(heaviest(weights[fold], np.frombuffer(b"".join(parts), np.int32), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.bool_()), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "summary"])

    return rows.mapInArrow(summarise, "toxic boolean, summary array<double>").toPandas()


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Classifier:
    """Learn from documents whose ids are not held out. Ids, languages and sources are not read as inputs."""
    model = language_model(docs)
    rows = stored(labelled(docs, labels, most), "labelled")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    by_label = [np.array([sizes.get((f, t), 0) for f in range(FOLDS)], float) for t in (False, True)]
    if not by_label[0].sum() or not by_label[1].sum():
        return Classifier(model, np.zeros(FEATURES, np.float32), None)
    counts = _feature_counts(rows, model)
    whole = counts.sum(0)
    others = [
        _weights(whole[1] - counts[f, 1], whole[0] - counts[f, 0], by_label[1].sum() - by_label[1][f], by_label[0].sum() - by_label[0][f])
        for f in range(FOLDS)
    ]
    found = _summaries(rows, model, others)
    x, y = np.array(found["summary"].tolist()), found["toxic"].to_numpy(float)
    return Classifier(model, _weights(whole[1], whole[0], by_label[1].sum(), by_label[0].sum()), _logistic(x, y))


def scored(docs: DataFrame, classifier: Classifier, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each text."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        return pd.Series(classifier.scores(texts.tolist()))

    return docs.withColumn(column, score(text_of("text")))


def harmless(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold."""
    rows = scored(docs, fit(docs, labels), "__llm_score")
    return rows.filter(F.col("__llm_score") < threshold).select(*docs.columns)
