import random
import re
from itertools import combinations
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlake.llm import common, near_dups, sketches

SCHEMA = "doc_id bigint, text string, node string, key int, registers string, kept string"


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(docs, width, percent):
    """Components by all pairs; documents are (id, text)."""
    sets = [(i, shingle_set(t, width)) for i, t in docs]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets))


def family(r, base, n, step):
    """Texts in which each changes a few words of the one before, so that far ones are linked only through others."""
    texts = [list(base)]
    for _ in range(n - 1):
        words = list(texts[-1])
        for _ in range(step):
            words[r.randrange(len(words))] = f"n{r.randrange(10**9)}"
        texts.append(words)
    return [" ".join(w) for w in texts]


def corpus():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(prose(r.randint(1, 300))) for _ in range(40)]
    texts += family(r, prose(200), 12, 4) + family(r, prose(120), 12, 2) + family(r, prose(400), 6, 20)
    base = prose(150)
    texts += [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 150, 5)]  # all near one another
    shared = prose(100)
    texts += [" ".join(shared + prose(n)) for n in (5, 8, 10, 14, 18, 25, 60, 100)]
    texts += ["same text here", "Same  TEXT here", "a", "a", "A b", "a b", "", "  ", None, "É b c", "é b c", "x y z " * 3000, "x y z " * 2999]
    ids = list(range(1, len(texts) + 1))
    r.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, rows, width, percent):
    docs = corpus()
    found = near_dups.grouped(spark.createDataFrame([(i, t, "n", 1, "r", "k") for i, t in docs], SCHEMA).repartition(4), width, percent)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(docs, width, percent), key=repr)


@pytest.mark.parametrize(("block", "shingles"), [(3, 10**6), (1000, 500)])
def test_mixed_clusters_are_compared_in_blocks(spark, rows, monkeypatch, block, shingles):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", shingles)
    docs = [(i, t) for i, t in corpus() if i % 2]
    found = near_dups.grouped(spark.createDataFrame([(i, t, "n", 1, "r", "k") for i, t in docs], SCHEMA), 3, 85)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(docs, 3, 85), key=repr)


def test_one_row_of_a_group_stays_and_ids_may_be_missing_or_repeat(spark):
    text = " ".join(f"t{i}" for i in range(60))
    near = text.replace("t59", "other")
    data = [(5, text), (2, near), (None, near), (None, "alone here and nowhere else at all"), (7, ""), (8, None), (9, "one two three four five six"), (9, "one two three four five six")]
    docs = spark.createDataFrame([(i, t, "n", 1, "r", "k") for i, t in data], SCHEMA)
    found = near_dups.grouped(docs, 5, 80).collect()
    assert len(found) == len(data)
    assert {r.component_id for r in found if r.n_shingles in (56,)} == {2}
    kept = near_dups.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([data[1], *data[3:]], key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dups.grouped(empty).count() == 0
    assert near_dups.deduplicated(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 205), (203, 200), (205, 201)]
    found = near_dups.components(spark.createDataFrame(links, "node bigint, hub bigint")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots)
    assert all(roots[i] == 0 for i in range(41))
    assert all(roots[i] == 100 for i in range(100, 130))
    assert all(roots[i] == 200 for i in (200, 201, 203, 205))


def test_registers_merge_agree_and_estimate():
    r = np.random.Generator(np.random.PCG64(1))
    size = 400
    for similarity in (0.2, 0.5, 0.8, 0.95):
        n = 20_000
        both = int(2 * n * similarity / (1 + similarity))
        words = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = words[:n], np.concatenate([words[:both], words[n : 2 * n - both]])
        rows = sketches.registers([a, b, np.concatenate([a, b])], size).astype(int)
        assert (rows[2] == np.maximum(rows[0], rows[1])).all()
        assert abs((rows[0] == rows[1]).mean() - similarity) < 0.1
        more, less = np.array([(rows[0] > rows[1]).sum()]), np.array([(rows[0] < rows[1]).sum()])
        best, possible = sketches.estimates(more, less, size, np.array([len(a)]), np.array([len(b)]), 0.8)
        assert abs(best[0] - similarity) < 0.08
        assert possible[0] == (similarity >= 0.8)


def test_shingles_equal_brute_force_as_sets():
    texts = ["a b c d", "A  b\tc\nD", "a", "", " ", "a b", "é É x", "a\x85b c d", "a b c a b c a b c", "a\x1cb c d e"]
    for width in (1, 3, 5):
        found = sketches.shingles(texts, width)
        expected = [shingle_set(t, width) for t in texts]
        assert [len(f) for f in found] == [len(e) for e in expected]
        for i, j in combinations(range(len(texts)), 2):
            assert len(np.intersect1d(found[i], found[j])) == len(expected[i] & expected[j])


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.range(1, 40).select(F.col("id").alias("node"), (F.col("id") - 1).alias("hub"))
    assert {tuple(row) for row in near_dups.components(chain).collect()} == {(i, 0) for i in range(40)}
    assert near_dups.components(chain.filter("node < 0")).count() == 0


def test_only_clusters_of_several_components_are_compared(spark):
    star = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (9, 8)], "node long, hub long")
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 4), (4, 4)], "node long, root long")
    text = {i: f"a{i} b{i} c{i} d{i}" for i in range(1, 10)}
    text[3] = text[2]
    texts = spark.createDataFrame(list(text.items()), "node long, text string")
    size = near_dups.BAND * near_dups.bands(0.85)
    nodes = near_dups.sketched(texts.withColumnRenamed("node", "doc_id"), 3, 0.85).withColumnRenamed("doc_id", "node")
    seen = []
    with mock.patch.object(near_dups, "stored", lambda frame, label: seen.append((label, common.stored(frame, label))) or seen[-1][1]):
        found = near_dups.links_between(star, nodes, texts, roots, 3, size, 85).collect()
    compared = {row["node"] for label, frame in seen if label == "clusters" for row in frame.collect()}
    assert compared == {1, 2, 3, 8, 9} and [tuple(row) for row in found] == [(3, 2)]
