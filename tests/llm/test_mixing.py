from math import log

import pytest
from pyspark.sql import functions as F

from cardlake.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, block string, pass string, tokens int, n_tokens string"


def corpus(spark, sizes=(("big", 900), ("mid", 200), ("small", 40), (None, 25))):
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            i += 1
            rows.append((i, source, "w " * (1 + i % 7), "b", "p", 1, "n"))
    return spark.createDataFrame(rows + [(9001, "void", "", "b", "p", 1, "n"), (9002, "void", None, "b", "p", 1, "n"), (None, "mid", "x y", "b", "p", 1, "n"), (1, "big", "w w", "b", "p", 1, "n")], SCHEMA)


def totals(docs):
    return {r.source: r.t for r in docs.groupBy("source").agg(F.sum(mixing.words()).alias("t")).collect()}


def test_repetitions_keep_to_their_limit_and_use_it(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 20)
    docs = corpus(spark)
    rows = mixing.schedule(docs, ratio=1.0, repetitions=2.0).collect()
    tokens = totals(docs)
    read = {}
    for r in rows:
        read[r.source] = read.get(r.source, 0) + r.n_tokens
    assert all(read[s] <= 2 * tokens[s] for s in read)
    assert max(read[s] / tokens[s] for s in read if tokens[s]) > 1.9
    assert 0.97 * sum(tokens.values()) <= sum(read.values()) <= sum(tokens.values())
    assert read["void"] == 0 and sorted(r.doc_id for r in rows if r.source == "void") == [9001, 9002]
    passes = {}
    for r in rows:
        passes.setdefault((r.source, r["pass"]), []).append(r)
    for (source, number), some in passes.items():
        some.sort(key=lambda r: (r.start_token, r.n_tokens))
        at = 0
        for r in some:  # places follow each other without a gap
            assert r.start_token == at
            at += r.n_tokens
        blocks = [r.block for r in some]
        assert sum(a != b for a, b in zip(blocks, blocks[1:])) == len(set(blocks)) - 1
        whole = at == tokens[source]
        assert whole or number == max(p for s, p in passes if s == source)
    first, second = ([r.doc_id for r in sorted(passes["small", p], key=lambda r: r.start_token)] for p in (0, 1))
    assert first[:10] != second[:10]


def test_a_target_entropy_is_met(spark):
    each = mixing.sources(mixing.sizes(corpus(spark).select("source", mixing.words().alias("n_tokens"))))
    shares = [r.share for r in each.collect()]
    even = log(len(shares))
    plain = -sum(p * log(p) for p in shares)
    target = (even + plain) / 2
    power = mixing.exponent(each, entropy=target)
    raised = [p**power for p in shares]
    entropy = -sum(w / sum(raised) * log(w / sum(raised)) for w in raised)
    assert target <= entropy < target + 1e-4
    assert mixing.exponent(each, entropy=even + 1) == 0.0
    assert mixing.exponent(each, entropy=plain / 2) == 1.0
    assert mixing.exponent(each, repetitions=1000.0) == 0.0
    with pytest.raises(ValueError):
        mixing.exponent(each, repetitions=2.0, entropy=1.0)


def test_a_mixture_of_rows_reads_every_one(spark):
    docs = corpus(spark)
    found = mixing.mixed(docs)
    assert found.columns == docs.columns
    counts = {r.doc_id: (r.n, r.source) for r in found.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect() if r.doc_id != 1}
    assert set(counts) == {r.doc_id for r in docs.collect() if r.doc_id != 1}
    assert {n for n, s in counts.values() if s == "void"} == {1}
    assert {n for n, s in counts.values() if s == "big"} == {1}
    assert max(n for n, _ in counts.values()) == 2
    assert found.filter("doc_id = 1").count() == 2  # a repeated row stays repeated


def test_empty_and_wordless_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.schedule(empty).count() == 0 and mixing.mixed(empty).count() == 0
    wordless = spark.createDataFrame([(1, "a", " ", "b", "p", 1, "n"), (2, None, None, "b", "p", 1, "n")], SCHEMA)
    assert sorted((r.source or "", r["pass"], r.place) for r in mixing.schedule(wordless).collect()) == [("", 0, 0.0), ("a", 0, 0.0)]
    assert mixing.mixed(wordless).count() == 2


def test_a_source_that_one_document_dominates(spark):
    """The document is longer than the rest of the quota, whatever its place in the permutation."""
    rows = [(1, "long", "w " * 5000)] + [(i, "long", "w w") for i in range(2, 300)] + [(i, "other", "w " * 400) for i in range(1000, 1040)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    for ratio in (0.3, 0.5, 1.6):
        narrow = docs.select("source", mixing.words().alias("n_tokens"))
        planned = mixing.plan(narrow, ratio, 2.0, None)
        own = {r.source: r for r in planned.collect()}["long"]
        found = mixing.schedule(docs, ratio=ratio, repetitions=2.0)
        last = [r.n_tokens for r in found.filter("source = 'long'").collect() if r["pass"] == own.passes]
        fitting = sum(n for n in [5000] + [2] * 298 if n <= own.rest)
        assert own.rest == 0 or min(fitting, own.rest) - 2 <= sum(last) <= own.rest
        weights = mixing.realised(found, planned).collect()
        assert sum(r.read_share for r in weights) == pytest.approx(1.0) and sum(r.weight for r in weights) == pytest.approx(1.0)
