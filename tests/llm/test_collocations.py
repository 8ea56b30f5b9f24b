import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cardlake.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, n double, phrase int, threshold string"


def brute(rows, top, least, share=80):
    """The contract's rows, from the counts of all phrases."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lower = re.sub("[A-Z]", lambda found: found.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    result = []
    for lang, own in counts.items():
        n = sum(times for phrase, times in own.items() if len(phrase) == 1)
        candidates = {phrase: a for phrase, a in own.items() if len(phrase) > 1 and a >= least}
        dropped = {
            phrase[i : i + m]
            for phrase, a in candidates.items() for m in range(2, len(phrase)) for i in range(len(phrase) - m + 1)
            if 100 * a >= share * own[phrase[i : i + m]]
        }
        kept = []
        for phrase, a in candidates.items():
            if phrase not in dropped:
                score, cut = min((2000000 * a // (own[phrase[:k]] + own[phrase[k:]]), k) for k in range(1, len(phrase)))
                kept.append((-score, -a, " ".join(phrase).encode(), own[phrase[:cut]], own[phrase[cut:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(result)


def corpus(n, seed):
    """Texts with passages that repeat, words of different frequency, ties, and what separates words and pieces."""
    r = random.Random(seed)
    words = ["the", "of", "Straße", "ÀB", "x1", "naïve", "日本", "q-r", "\xa0", "'s", "a\x1cb", *(f"w{i}" for i in range(12))]
    passages = [[r.choice(words) for _ in range(r.randint(2, 6))] for _ in range(8)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(0, 12)):
            part = r.choice(passages) if r.random() < 0.5 else [words[min(int(r.expovariate(0.25)), len(words) - 1)] for _ in range(3)]
            text += r.choice([" ", "\t", "  "]).join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in part)
            text += r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!", "?", ";", ":", "\x0c"])
        rows.append((text, r.choice(["en", "en", "en", "de", None, "und"])))
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, text, lang, 0.5, i, "t") for i, (text, lang) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(row) for row in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize("top, least, seed", [(2000, 5, 1), (12, 3, 2), (5, 4, 4)])
def test_as_by_brute_force(spark, top, least, seed):
    """With wide frontiers and with narrow ones that have to move on."""
    rows = corpus(250, seed)
    assert found(spark, rows, top=top, least=least) == brute(rows, top, least)


def test_full_tables_change_nothing(spark, monkeypatch):
    """With so few bits that most phrases are in scope by a false hit, and a frontier that starts narrow."""
    rows = corpus(250, 5)
    monkeypatch.setattr(collocations, "FIRST", 1)
    assert found(spark, rows, top=15, least=4, bits=64) == brute(rows, 15, 4)


def test_hashes_that_clash_are_drawn_again(spark):
    """With one byte a hash, most salts give two words the same one."""
    rows = [(f"a b c d{i % 4} e f. {i % 5} g", "en") for i in range(60)]
    assert found(spark, rows, top=10, least=5, digest=1) == brute(rows, 10, 5)


def test_what_a_task_gives_does_not_depend_on_its_limits(monkeypatch):
    rows = corpus(100, 6)
    batch = pa.RecordBatch.from_pydict({"lang": [lang or "und" for _, lang in rows], "text": [text for text, _ in rows]})

    def results():
        one, two, blocks = Counter(), Counter(), []
        for part in collocations._encoder(0, 8)([batch, batch]):
            for lang, word, n in zip(*(part.column(c).to_pylist() for c in ("lang", "word", "n"))):
                one[lang, word] += n or 0
            some = part.filter(part.column("words").is_valid())
            blocks += [some.select(["words"])] if some.num_rows else []
        # Every pair is in scope of a table whose bits are all set.
        scope = collocations.Scope(2, words=collocations.BitTable(np.array([2**64 - 1], np.uint64)))
        for part in collocations._counter(scope)(blocks):
            for first, second, n in zip(*(part.column(c).to_pylist() for c in ("w1", "w2", "n"))):
                two[first, second] += n
        return one, two

    wide = results()
    for name, limit in (("BUFFER", 50), ("KNOWN", 5), ("GROUP_BYTES", 20), ("ROW", 3), ("BATCH_ROWS", 2)):
        monkeypatch.setattr(collocations, name, limit)
    assert results() == wide and len(wide[1]) > 100


def test_distinct_rows_of_hashes():
    r = np.random.Generator(np.random.PCG64(1))
    for width in (1, 2, 3, 4):
        columns = [r.integers(0, 4, 500).astype(np.uint64) for _ in range(width)]
        rows, times = collocations.distinct(columns)
        assert Counter(dict(zip(zip(*(column.tolist() for column in rows)), times.tolist()))) == Counter(zip(*(column.tolist() for column in columns)))
    assert [len(x) for x in (*collocations.distinct([np.empty(0, np.uint64)] * 2)[0], collocations.distinct([np.empty(0, np.uint64)] * 2)[1])] == [0, 0, 0]


def test_rests_of_three_words_outside_the_frontier(spark):
    """A phrase whose last three words, which score little, were not counted with the others."""
    rows = [("aa bb c d", "en")] * 40 + [("c d", "en")] * 400 + [(f"x{i} bb c", "en") for i in range(300)] + [(f"k{i % 7} m{i % 7}", "en") for i in range(700)]
    for top in (1, 7):
        assert found(spark, rows, top=top, least=30) == brute(rows, top, 30)


def test_a_group_of_copies_and_a_very_long_text(spark):
    rows = [("one two three four five", "en")] * 3000 + [("six seven " * 20_000, "en"), (None, "en"), ("", None), ("a b c", "fr")]
    assert found(spark, rows, top=2000, least=30) == brute(rows, 2000, 30)


def test_ties_go_by_count_and_bytes(spark):
    pairs = ["b z", "a é", "a z", "a ￿", "a 😀"]
    rows = [(pair, "en") for pair in pairs for _ in range(30)] + [("c d", "en")] * 31
    assert found(spark, rows, top=4, least=30) == brute(rows, 4, 30)


def test_empty_tables(spark):
    assert found(spark, [("never often", "en"), (None, None)]) == []
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_bound_is_below_a_score(spark):
    docs = spark.createDataFrame(corpus(200, 6), "text string, lang string").fillna("und", ["lang"])
    blocks, words, salt = collocations.encoded(docs)
    single = words.selectExpr("lang", "word as phrase", "n")
    two = collocations.scored(collocations.counted(blocks, words, collocations.Scope(2, words=collocations.Tables(salt).of(single)), 2), single)
    assert two.count() and two.filter("score > bound").count() == 0


def test_scores_beyond_64_bits(spark):
    frame = spark.createDataFrame([(10**17, 3 * 10**17)], "a bigint, total bigint")
    assert frame.select(collocations.score("a", "cast(total as decimal(20,0))")).first()[0] == 2_000_000 * 10**17 // (3 * 10**17)
