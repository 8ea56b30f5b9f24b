import random
import re
import shutil
from collections import Counter

import pytest

from cardlake.llm import quality

SCHEMA = "doc_id bigint, text string, words string, failed string, lines int"
_random = random.Random(4)
TEXTS = [
    None, "", " ", "one", "a b", "a b c", "a b c a b c", "a a a a", "a b c d a b c e a b c", "x\nx\n \nx\ny", "# $ & | < > % *",
    "LOUD WORDS! " * 60, "a | b " * 40, "\n\n\n", "é ü ß\x0bz\x1cz", "😀 😀 😀 😀", "y" * 3000, "\r\na\r\na", "a\tb\x0cc a\tb\x0cc",
] + [" ".join(_random.choice("abcde") for _ in range(_random.randint(0, 120))) for _ in range(60)] + [
    "\n".join(" ".join(_random.choice(["to", "be", "or", "not", "Q", "#1"]) for _ in range(_random.randint(0, 9))) for _ in range(30)) for _ in range(10)
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def ledger(spark):
    docs = spark.createDataFrame([(i, t, "w", "f", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    return quality.verdicts(quality.ledger(docs)).cache()


def test_measurements_equal_brute_force(ledger):
    for r in ledger.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_texts_with_more_words_than_positions_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(quality, "PACKED_WORDS", 16)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    for r in quality.measured(docs).collect():
        assert r.n_repeat_words == brute(TEXTS[r.doc_id])[4]


def test_policies_and_ablations_read_only_bits(ledger):
    rows = ledger.select("failed", "kept").collect()
    active = quality.mask(quality.CURRENT)
    assert sum(r.kept for r in rows) == sum(r.failed & active == 0 for r in rows)
    for found in quality.ablations(ledger).collect():
        bit = 1 << next(rule.bit for rule in quality.RULES if rule.name == found.rule)
        assert found.n_failed == sum(bool(r.failed & bit) for r in rows)
        assert found.n_failed_alone == sum(r.failed & active == bit for r in rows)
        assert found.n_kept_without == sum(r.failed & active & ~bit == 0 for r in rows)


def test_policies_of_a_stored_ledger_read_no_text(spark, tmp_path):
    """The texts are gone when the policies are applied; null ids, repeated rows and a long text are in the ledger."""
    rows = [(None, "a b c a b c", "w", "f", 1)] * 3 + [(1, "same " * 60, "w", "f", 1)] * 2 + [(2, "w%d " * 1, "w", "f", 1), (3, " ".join(f"w{i}" for i in range(60_000)), "w", "f", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/docs")
    quality.ledger(spark.read.parquet(f"{tmp_path}/docs")).write.parquet(f"{tmp_path}/ledger")
    shutil.rmtree(tmp_path / "docs")
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    for policy in quality.POLICIES:
        found = sorted(((r.doc_id or 0, r.n_words, r.kept) for r in quality.verdicts(ledger, policy).collect()))
        assert found == [(0, 6, False)] * 3 + [(1, 60, False)] * 2 + [(2, 1, False), (3, 60_000, True)]
        assert quality.ablations(ledger, policy).count() == len(quality.POLICIES[policy])


def test_empty_table(spark):
    empty = quality.ledger(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    assert quality.ablations(empty).count() == 0
