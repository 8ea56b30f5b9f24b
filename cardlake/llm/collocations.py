"""Collocations of every language by best-first growth with score bounds.

Texts are read once and stored as hashes of their words, under a salt for which no two words share one, so a hash stands
for its word. A phrase grows from its prefix. The prefix's count bounds the score of everything that grows from it: if the first k
words occur l times and the prefix a times, no longer phrase scores above 2000000 * a / (l + a). Words are counted
first, then pairs of frequent words. A threshold per language, taken from the scores of its pairs, is the frontier: only
prefixes whose bound reaches it are grown to three and four words, and phrases around a pair or triple that reaches it,
which may displace it. A language is settled when enough phrases at or above the threshold survive, ties included;
otherwise its threshold falls and the frontier moves on, until nothing is left below it.

Which phrases are counted is decided by bit tables of hashes with ``BITS`` bits at any size of the corpus. A false hit
counts a phrase more; none is missed, and what is counted is counted everywhere, by the phrase itself. So all counts and
results are exact, and where the tables fill up only the pruning gets weaker.

Null languages are ``und``; null and empty texts have no words. Rows that repeat count each. Extra columns are not read.
Texts of any length are read whole. Languages without candidates have no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardlake.llm.common import ship, stored, text_of
from cardlake.llm.sketches import mixed

TOP, LEAST, SHARE = 2000, 30, 80
# Bits of the table of a set of phrases, and bytes of a word's hash.
BITS, DIGEST = 2**25, 8
# Bytes of texts and words that are worked on together, and words known to a task; results do not depend on them.
GROUP_BYTES, BUFFER, KNOWN = 1_000_000, 1_000_000, 500_000
# Words of a stored row, and rows that leave a task together.
ROW, BATCH_ROWS = 512, 50_000
# Classes of scores for each doubling, from which thresholds are taken.
CLASSES = 64
# The first threshold lets in so many times the wanted pairs, each further one WIDER times more.
FIRST, WIDER = 2, 4
ENCODED = "lang string, words array<bigint>, word string, hash bigint, n bigint"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
NOTHING, BORDER = 0, 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers of one language's words, given out when first asked for."""

    def __init__(self, lang: bytes, owner: Vocabulary):
        super().__init__({b"": NOTHING, b"\n": BORDER})
        self.lang, self.owner = lang, owner

    def __missing__(self, word: bytes) -> int:
        owner = self.owner
        number = self[word] = len(owner.words)
        owner.words.append(word)
        owner.langs.append(self.lang)
        return number


class Vocabulary:
    """The words of a task by number, how often each was met, and a hash of each that every task has alike."""

    def __init__(self, salt: int, digest: int):
        self.salt, self.digest = salt, digest
        self.words, self.langs, self.by_lang = [b"", b""], [b"", b""], {}
        self.hashes, self.counts = np.zeros(2, np.uint64), np.zeros(2, np.int64)

    def read(self, lang: bytes, texts: list[bytes]) -> np.ndarray:
        """Hashes of the words of texts of one language, with 0 between pieces and texts."""
        own = self.by_lang.get(lang)
        if own is None:
            own = self.by_lang[lang] = _Numbers(lang, self)
        tokens = b"\n".join([*texts, b""]).translate(_LOWER).replace(b"\n", b" \n ").split(b" ")
        numbers = np.fromiter(map(own.__getitem__, tokens), np.int64, len(tokens))
        known = len(self.hashes)
        if known < len(self.words):
            new = b"".join([word_hash(lang, word, self.salt, self.digest) for word in self.words[known:]])
            self.hashes = np.append(self.hashes, np.frombuffer(new, np.uint64))
            self.counts = np.append(self.counts, np.zeros(len(self.words) - known, np.int64))
        self.counts += np.bincount(numbers, minlength=len(self.counts))
        return self.hashes[numbers[numbers != NOTHING]]

    def rows(self):
        """Every word with its count."""
        for start in range(2, len(self.words), BATCH_ROWS):
            part = slice(start, start + BATCH_ROWS)
            langs, words = (pa.array(values[part], pa.binary()).cast(pa.string()) for values in (self.langs, self.words))
            none = pa.nulls(len(words), pa.list_(pa.int64()))
            columns = [langs, none, words, pa.array(self.hashes[part].view(np.int64)), pa.array(self.counts[part])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "word", "hash", "n"])


def word_hash(lang: bytes, word: bytes, salt: int, digest: int = DIGEST) -> bytes:
    """Eight bytes, of which ``digest`` are used."""
    key = hashlib.blake2b(lang, digest_size=16).digest()
    return hashlib.blake2b(word, digest_size=digest, key=key, salt=salt.to_bytes(8, "little")).digest().ljust(8, b"\0")


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on by one word."""
    return mixed(hashes * _STEP + words)


def _blocks(batches):
    """Languages with texts of bounded size, texts of one language together."""
    some, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").cast(pa.binary()).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            some.setdefault(lang, []).append(text)
            size += len(text)
            if size > GROUP_BYTES:
                yield from some.items()
                some, size = {}, 0
    yield from some.items()


def _encoder(salt: int, digest: int):
    """Words as hashes in rows that are cut between pieces, and at the end the words themselves."""

    def encode(batches):
        known = Vocabulary(salt, digest)
        for lang, texts in _blocks(batches):
            hashes = known.read(lang, texts)
            borders = np.flatnonzero(hashes == 0) + 1
            wanted = np.searchsorted(borders, np.arange(ROW, len(hashes), ROW))
            cuts = np.unique(np.concatenate([[0], borders[wanted[wanted < len(borders)]], [len(hashes)]]))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes.view(np.int64)))
            n = len(lists)
            columns = [pa.array([lang] * n, pa.binary()).cast(pa.string()), lists, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "word", "hash", "n"])
            if len(known.words) > KNOWN:
                yield from known.rows()
                known = Vocabulary(salt, digest)
        yield from known.rows()

    return encode


def encoded(rows: DataFrame, digest: int = DIGEST) -> tuple[DataFrame, DataFrame, int]:
    """The texts as hashes of words, the words with hash and count, and the salt under which no two words share a hash."""
    ship(rows.sparkSession)
    for salt in itertools.count():
        both = stored(rows.select("lang", "text").mapInArrow(_encoder(salt, digest), ENCODED), "encoded")
        words = both.filter("word is not null").groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))
        words = stored(words, "words")
        # A hash of 0 would be a border.
        clashes = words.groupBy("hash").agg(F.count("*").alias("words")).filter("words > 1 or hash = 0")
        if clashes.isEmpty():
            return both.filter("words is not null").select("lang", "words"), words, salt


def _spot(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bit of a hash in a table of ``size`` bits, a power of two."""
    return hashes >> np.uint64(65 - size.bit_length())


class BitTable:
    """A set of phrases by one bit of their hashes: no member is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        spot = _spot(hashes, 64 * len(self.bits))
        return (self.bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)


class Tables:
    """Makes bit tables of phrases, hashed as the words of :func:`encoded`."""

    def __init__(self, salt: int, bits: int = BITS, digest: int = DIGEST):
        self.salt, self.bits, self.digest = salt, bits, digest

    def of(self, phrases: DataFrame) -> BitTable:
        """The table of the rows' languages and phrases."""
        salt, size, digest = self.salt, self.bits, self.digest

        def spots(batches):
            for batch in batches:
                found = []
                for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                    words = np.frombuffer(b"".join([word_hash(lang.encode(), word, salt, digest) for word in phrase.encode().split(b" ")]), np.uint64)
                    found.append(reduce(longer, (words[k : k + 1] for k in range(1, len(words))), mixed(words[:1]))[0])
                yield pa.RecordBatch.from_arrays([pa.array(_spot(np.array(found, np.uint64), size).astype(np.int64))], names=["spot"])

        mask = F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("mask")
        rows = phrases.select("lang", "phrase").mapInArrow(spots, "spot bigint").groupBy(F.shiftright("spot", 6).alias("at")).agg(mask)
        # At most bits / 64 rows.
        found = rows.toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        return BitTable(bits)


class Scope:
    """Which phrases of a length are counted, by what is known of the shorter phrases inside."""

    def __init__(self, length: int, **tables: BitTable):
        self.length, self.tables = length, tables

    def starts(self, words: np.ndarray) -> np.ndarray:
        """Where phrases in scope start, in hashes of words with 0 between pieces."""
        if len(words) < self.length:
            return np.empty(0, np.int64)
        tables, inside, one = self.tables, words != 0, mixed(words)
        if self.length == 2:
            found = inside & tables["words"].holds(one)
            return np.flatnonzero(found[:-1] & found[1:])
        two = longer(one[:-1], words[1:])
        # Three neighbouring words, all of whose pairs are frequent.
        pairs = inside[:-1] & inside[1:]
        spots = np.flatnonzero(pairs)
        pairs[spots] = tables["pairs"].holds(two[spots])
        at = np.flatnonzero(pairs[:-1] & pairs[1:])
        three = longer(two[at], words[at + 2])
        if "tails" in tables:
            return at[tables["tails"].holds(three)]
        in_scope = tables["grown"].holds(two[at]) | tables["near"].holds(two[at + 1])
        if self.length == 3:
            return at[in_scope]
        # A triple that was counted and is not frequent has no frequent phrase around it.
        possible = ~in_scope | tables["triples"].holds(three)
        grown, near = tables["grown triples"].holds(three), tables["near triples"].holds(three)
        follows = np.flatnonzero(np.append(np.diff(at) == 1, False)) if len(at) else at
        wanted = grown[follows] | near[follows + 1]
        for k in range(3):
            wanted |= tables["near"].holds(two[at[follows] + k])
        return at[follows][wanted & possible[follows] & possible[follows + 1]]


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of hashes, and how often each occurs.

    Rows are ordered by one hash of all columns; where two different rows share it, by the columns themselves.
    """
    order = np.argsort(reduce(longer, columns[1:], columns[0]), kind="stable")
    key = reduce(longer, columns[1:], columns[0])[order]
    ordered = [column[order] for column in columns]
    differs = [column[1:] != column[:-1] for column in ordered]
    new = reduce(np.logical_or, differs)
    if (new & (key[1:] == key[:-1])).any():
        order = np.lexsort(columns[::-1])
        ordered = [column[order] for column in columns]
        new = reduce(np.logical_or, [column[1:] != column[:-1] for column in ordered])
    first = np.flatnonzero(np.append(np.ones(min(1, len(order)), bool), new))
    return [column[first] for column in ordered], np.diff(np.append(first, len(order)))


def _counter(scope: Scope):
    names = [f"w{k}" for k in range(1, scope.length + 1)] + ["n"]

    def counts(buffer):
        words = np.concatenate([np.empty(0, np.uint64), *buffer])
        starts = scope.starts(words)
        columns, times = distinct([words[starts + k] for k in range(scope.length)])
        for start in range(0, len(times), BATCH_ROWS):
            part = slice(start, start + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([*(pa.array(column[part].view(np.int64)) for column in columns), pa.array(times[part])], names=names)

    def count(batches):
        buffer, size = [], 0
        for batch in batches:
            # Every row ends with a border or the end of a text, and so does every batch.
            column = batch.column("words")
            buffer.append(column.flatten().to_numpy().view(np.uint64))
            size += len(buffer[-1])
            if size > BUFFER:
                yield from counts(buffer)
                buffer, size = [], 0
        yield from counts(buffer)

    return count


def counted(blocks: DataFrame, words: DataFrame, scope: Scope, least: int = 1) -> DataFrame:
    """Occurrences of every phrase in scope within pieces, overlapping ones included, if it has ``least`` or more.

    ``words`` has all words of such phrases.
    """
    numbered = [f"w{k}" for k in range(1, scope.length + 1)]
    found = blocks.select("words").mapInArrow(_counter(scope), ", ".join(f"{name} bigint" for name in [*numbered, "n"]))
    found = found.groupBy(*numbered).agg(F.sum("n").alias("n"))
    found = stored(found.filter(F.col("n") >= least) if least > 1 else found, "counted")
    for name in numbered:
        lang = ["lang"] if name == "w1" else []
        found = found.join(words.select(F.col("hash").alias(name), F.col("word").alias(f"{name}_word"), *lang), name)
    return found.select("lang", F.concat_ws(" ", *(f"{name}_word" for name in numbered)).alias("phrase"), "n")


def score(a: str, total: str):
    """floor(2000000 * a / total), exact beyond 64 bits."""
    return F.expr(f"(2000000 * cast({a} as decimal(20, 0))) div ({total})")


def scored(found: DataFrame, parts: DataFrame) -> DataFrame:
    """The lowest-scoring cut of every phrase, and the bound for what grows from it.

    Where the count of a rest is not among ``parts``, ``unknown`` is set and the score is a bound, too.
    """
    words = F.split("phrase", " ")
    size = F.size(words)
    cuts = found.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "*", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, size - F.col("k")), " ").alias("rest")
    )
    firsts = parts.select("lang", F.col("phrase").alias("first"), F.col("n").cast("decimal(20,0)").alias("l"))
    rests = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").cast("decimal(20,0)").alias("r"))
    cuts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"], "left").withColumn("bound", score("a", "l + a"))
    value = F.coalesce(score("a", "l + r"), "bound").alias("score")
    cut = F.min(F.struct(value, "k", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("cut")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(cut, F.min("bound").alias("bound"), F.max(F.col("r").isNull()).alias("unknown"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "bound", "unknown")


def thresholds(pairs: DataFrame, langs: DataFrame, wanted: int) -> DataFrame:
    """For each language a score that ``wanted`` pairs reach; 0, if it has fewer."""
    kind = F.floor(F.log2(F.col("score") + 1) * CLASSES).alias("kind")
    classes = pairs.groupBy("lang", kind).agg(F.min("score").alias("least"), F.count("*").alias("pairs"))
    # At most 21 * CLASSES rows a language.
    above = F.sum("pairs").over(Window.partitionBy("lang").orderBy(F.desc("kind")))
    reached = classes.withColumn("above", above).filter(F.col("above") >= wanted).groupBy("lang").agg(F.max("least").alias("least"))
    return langs.join(reached, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).cast("long").alias("threshold"))


def _as_counts(found: DataFrame) -> DataFrame:
    return found.select("lang", "phrase", F.col("a").alias("n"))


def frontier(blocks: DataFrame, words: DataFrame, pairs: DataFrame, limits: DataFrame, tables: Tables, least: int, share: int) -> DataFrame:
    """All surviving phrases that reach their language's threshold, for the languages of ``limits``."""
    blocks = blocks.join(limits, "lang", "left_semi")
    own = pairs.join(limits, "lang")
    reaches, grows = F.col("score") >= F.col("threshold"), F.col("bound") >= F.col("threshold")
    known = {"pairs": tables.of(own), "grown": tables.of(own.filter(grows)), "near": tables.of(own.filter(reaches))}
    parts = words.select("lang", F.col("word").alias("phrase"), "n").unionByName(_as_counts(pairs))
    triples = stored(scored(counted(blocks, words, Scope(3, **known), least), parts), "triples")
    threes = triples.join(limits, "lang")
    known |= {"triples": tables.of(triples), "grown triples": tables.of(threes.filter(grows)), "near triples": tables.of(threes.filter(reaches))}
    fours = stored(counted(blocks, words, Scope(4, **known), least), "fours")
    parts = parts.unionByName(_as_counts(triples))
    whole = stored(scored(fours, parts).join(limits, "lang").filter(reaches), "whole-fours")
    unknown = whole.filter("unknown")
    if not unknown.isEmpty():
        # Rests of three words that were out of scope.
        tails = unknown.select("lang", F.array_join(F.slice(F.split("phrase", " "), 2, 3), " ").alias("phrase")).distinct()
        counts = counted(blocks, words, Scope(3, pairs=known["pairs"], tails=tables.of(tails)))
        missing = stored(counts.join(tails, ["lang", "phrase"], "left_semi"), "tails")
        whole = scored(whole.select("lang", "phrase", F.col("a").alias("n")), parts.unionByName(missing)).join(limits, "lang").filter(reaches)
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    reached = reduce(DataFrame.unionByName, [frame.filter(reaches).select(columns) for frame in (own, threes, whole)])
    inside = F.expr(
        "explode(flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), "
        "i -> array_join(slice(words, i, m), ' ')))))"
    )
    around = _as_counts(triples).unionByName(fours).withColumn("words", F.split("phrase", " ")).select("lang", "n", inside.alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    held = F.expr(f"100 * cast(around as decimal(20, 0)) >= {share} * cast(a as decimal(20, 0))")
    return reached.join(around, ["lang", "phrase"], "left").filter(~F.coalesce(held, F.lit(False))).drop("around")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, bits: int = BITS, digest: int = DIGEST) -> DataFrame:
    """The best ``top`` phrases of two to four words of each language.

    Candidates occur ``least`` times or more. One is left out if a longer one around it occurs ``share`` percent as often.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of("text").alias("text"))
    blocks, every, salt = encoded(rows, digest)
    tables = Tables(salt, bits, digest)
    totals = stored(every.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = stored(every.filter(F.col("n") >= least), "frequent-words")
    single = words.select("lang", F.col("word").alias("phrase"), "n")
    pairs = stored(scored(counted(blocks, words, Scope(2, words=tables.of(single)), least), single), "pairs")
    langs, wanted, done = stored(pairs.select("lang").distinct(), "langs"), FIRST * top, []
    while not langs.isEmpty():
        limits = stored(thresholds(pairs, langs, wanted), "thresholds")
        found = stored(frontier(blocks, words, pairs, limits, tables, least, share), "survivors")
        sizes = limits.join(found.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left")
        settled = (F.coalesce("found", F.lit(0)) >= top) | (F.col("threshold") == 0)
        sizes = stored(sizes.select("lang", settled.alias("settled")), "settled")
        done.append(found.join(sizes.filter("settled"), "lang", "left_semi"))
        langs, wanted = sizes.filter("not settled").select("lang"), wanted * WIDER
    if not done:
        done = [pairs.select("lang", "phrase", "a", "l", "r", "score")]
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
