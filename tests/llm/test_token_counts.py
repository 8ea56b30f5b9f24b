import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cardlake.llm import token_counts
from cardlake.llm.byte_bpe import PrefixTokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id bigint, text string, n_tokens string, prefix_deltas int"
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'re", "'ll", "'s", "!", "'", "é", "\xa0", "日本", "😀", "1", "23", "<|endoftext|>", "<|end",
         "----------------", "        ", "　", "\x1c", "​", "ſ", "'ſ", "_", "don't", "\r\n", "́", "x" * 70]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.VOCABULARY)


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 10))) for _ in range(n)]


def test_every_prefix_has_the_library_s_count(library):
    own = PrefixTokenizer(token_counts.VOCABULARY)
    for text in texts(600):
        found = own.deltas(text)
        assert len(found) == len(text)
        for i in range(len(text) + 1):
            assert token_counts.tokens_at(found, i) == len(library.encode(text[:i], add_special_tokens=False).ids), text[:i]
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_counts_and_truncation_of_a_table(spark, library):
    some = [None, "", "one two three " * 400, "x" * 100_000, " " * 5000, *texts(50, 2)]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "n", 1) for i, t in enumerate(some)] + [(2, some[2], "n", 1)], SCHEMA)
    found = token_counts.truncated(token_counts.prefix_counts(docs), 30).collect()
    assert len(found) == len(some) + 1
    for r in found:
        text = some[3 if r.doc_id is None else r.doc_id] or ""
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 30)
        kept = r.chars_in_limit
        assert len(library.encode(text[:kept], add_special_tokens=False).ids) <= 30
        if len(text) < 500:
            assert kept == max(i for i in range(len(text) + 1) if len(library.encode(text[:i], add_special_tokens=False).ids) <= 30)


def test_counts_do_not_depend_on_the_caches(monkeypatch):
    from cardlake.llm import byte_bpe

    some = texts(200, 7)
    wide = [PrefixTokenizer(token_counts.VOCABULARY).count(t) for t in some]
    monkeypatch.setattr(byte_bpe, "CACHED", 2)
    own = PrefixTokenizer(token_counts.VOCABULARY)
    assert [own.count(t) for t in some] == wide
    assert np.sum(wide) > 0


def test_empty_table(spark):
    assert token_counts.truncated(token_counts.prefix_counts(spark.createDataFrame([], SCHEMA)), 5).count() == 0
