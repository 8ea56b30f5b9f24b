import random

import numpy as np

from cardlake.llm import packing

SCHEMA = "doc_id bigint, text string, shard string, row int, ids string"


def brute_best_fit(sizes, length):
    free = []
    for size in sizes:
        fits = [(f, i) for i, f in enumerate(free) if f >= size]
        if fits:
            least = min(f for f, _ in fits)
            free[next(i for f, i in fits if f == least)] -= size
        else:
            free.append(length - size)
    return sorted(free)


def test_best_fit_equals_a_search_over_all_rows():
    r = random.Random(2)
    for length in (1, 2, 7, 64, 100):
        for _ in range(40):
            sizes = sorted((r.randint(1, length) for _ in range(r.randint(0, 60))), reverse=True)
            rows = packing.best_fit(sizes, length)
            assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
            assert sorted(length - sum(sizes[i] for i in row) for row in rows) == brute_best_fit(sizes, length)


def test_rows_hold_every_token_once(spark):
    r = random.Random(3)
    texts = {i: " ".join(r.choice(["alpha", "be", "<|endoftext|>", "日本", "\n"]) for _ in range(r.randint(0, 300))) for i in range(1, 120)}
    texts |= {500: "", 501: None, 502: "long text " * 20_000}
    docs = spark.createDataFrame([(i, t, "s", 1, "x") for i, t in texts.items()] + [(None, "nameless", "s", 1, "x")], SCHEMA).repartition(3)
    found = packing.packed(docs, length=64, shard_bytes=20_000)
    rows = found.collect()
    assert len({row.shard for row in rows}) > 3
    encoder = packing.encoding(packing.VOCABULARY)
    expected = {i: [*encoder.encode_ordinary(t or ""), packing.SEPARATOR] for i, t in [*texts.items(), (None, "nameless")]}
    parts = {}
    for row in rows:
        line = np.frombuffer(row.ids, packing.IDS)
        assert len(line) == 64 and row.cu_seqlens[0] == 0 and row.cu_seqlens[-1] == row.n_tokens
        assert (line[row.n_tokens :] == packing.SEPARATOR).all()
        places = packing.positions(row.position_resets, 64)
        for doc_id, start, low, high in zip(row.doc_ids, row.starts, row.cu_seqlens, row.cu_seqlens[1:]):
            parts.setdefault(doc_id, []).append((start, line[low:high].tolist()))
            assert places[low:high].tolist() == list(range(high - low))
    assert {i: [t for _, part in sorted(p) for t in part] for i, p in parts.items()} == expected
    back = {row.doc_id: np.frombuffer(row.ids, packing.IDS).tolist() for row in packing.unpacked(found).collect()}
    assert back == {i: ids[:-1] for i, ids in expected.items()}
    assert sum(row.n_tokens for row in rows) / (64 * len(rows)) > 0.9
    assert packing.matrix([row.ids for row in rows], 64).shape == (len(rows), 64)


def test_matrices_are_written_and_read_back(spark, tmp_path):
    r = random.Random(5)
    texts = {i: " ".join(r.choice(["alpha", "be", "日本"]) for _ in range(r.randint(0, 200))) for i in range(150)}
    docs = spark.createDataFrame([(i, t, "s", 1, "x") for i, t in texts.items()], SCHEMA).repartition(3)
    path = str(tmp_path / "matrices")
    rows = packing.packed(docs, length=64, shard_bytes=5_000)
    assert rows.rdd.getNumPartitions() > 1
    packing.write_matrices(rows, path)
    back = packing.read_matrices(spark, path)
    assert back.dtypes == rows.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    encoder = packing.encoding(packing.VOCABULARY)
    found = {row.doc_id: np.frombuffer(row.ids, packing.IDS).tolist() for row in packing.unpacked(back).collect()}
    assert found == {i: encoder.encode_ordinary(t) for i, t in texts.items()}
    # A shard lies whole in one file, its rows in order.
    placed = back.selectExpr("_metadata.file_name AS f", "shard", "row", "monotonically_increasing_id() AS at").collect()
    assert len({row.shard for row in placed}) == len({(row.f, row.shard) for row in placed}) > 3
    for shard in {row.shard for row in placed}:
        own = sorted((row for row in placed if row.shard == shard), key=lambda row: row.at)
        assert [row.row for row in own] == list(range(len(own)))
    packing.write_matrices(packing.packed(docs.limit(0)), path)
    assert packing.read_matrices(spark, path).count() == 0


def test_rows_that_repeat_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same", "s", 1, "x")] * 5, SCHEMA)
    assert sum(len(row.doc_ids) for row in packing.packed(docs).collect()) == 5
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0
