import hashlib
import re

import pytest

from cardlake.llm import exact_dedup
from cardlake.session import scratch_dir

SCHEMA = "doc_id bigint, text string, key string, head int, norm string, bucket string, id string"
ROWS = [(i, t, "k", 1, "n", "b", "x") for i, t in [
    (5, "a b"), (3, "a  b"), (9, "a\tb"), (4, " a b"), (7, None), (8, ""), (6, "A b"), (2, "x" * 50_000), (1, "x" * 50_000),
    (None, "a\n\x0bb"), (None, "only here"), (None, "only here"), (11, "twice"), (11, "twice"), (12, "a\x85b"), (13, "a b "),
    (14, " "), (15, "  "),
] + [(100 + i, f"text {i % 40}") for i in range(120)]]


def expected(rows):
    norm = {}
    for doc_id, text, *_ in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in norm.items():
        head = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, head, len(ids), i == head, digest) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity, bits", [(1000, 64), (4, 64), (4, 3), (1, 1)])
def test_groups_equal_brute_force(spark, rows, capacity, bits):
    found = exact_dedup.groups(spark.createDataFrame(ROWS, SCHEMA), capacity, bits)
    assert rows(found) == expected(ROWS)


def test_buckets_hold_their_capacity_and_their_range(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id bigint, text string")
    index = exact_dedup.build_index(docs, scratch_dir(spark, "index"), capacity=16)
    found = index.collect()
    assert len(found) == 400
    sizes, prefixes = {}, {}
    for r in found:
        sizes[r.bucket] = sizes.get(r.bucket, 0) + 1
        prefixes.setdefault(r.bucket, set()).add((r.key & (2**64 - 1)) >> (64 - r.depth) if r.depth else 0)
    assert max(sizes.values()) <= 16
    assert all(len(p) == 1 for p in prefixes.values())
    assert len({r.depth for r in found}) > 1  # only overfull buckets were split


def test_one_row_of_each_group_stays_with_all_columns(spark, rows):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    heads = [r[0] for r in expected(ROWS) if r[3] or (r[0] is None and r[1] is None)]
    assert sorted(ids, key=repr) == sorted(set(heads), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.deduplicated(empty).count() == 0
