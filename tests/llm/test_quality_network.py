import random

import numpy as np
import pytest
from conftest import SF_DIR

from cardlake.llm import quality_network
from cardlake.llm.quality_network import BLOCK, FILTERS, STRIDE, WIDTH, Network, laid_out, repeats
from cardlake.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, score string, h int, good string, size double"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def prose(r, n):
    return " ".join("".join(r.choice(["an", "the", "ing", "er", "on", "ti"]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."


def junk(r, n):
    kind = r.randint(0, 2)
    words = prose(r, n).split()
    if kind == 0:
        return " ".join(w + "$$$" for w in words)
    return " ".join(w for w in words for _ in range(6)) if kind == 1 else " | ".join(words)


def corpus(n, seed):
    r = random.Random(seed)
    good = [r.random() < 0.7 for _ in range(n)]
    return [prose(r, r.randint(5, 200)) if g else prose(r, r.randint(0, 100)) + " " + junk(r, 60) for g in good], np.array(good, np.float32)


@pytest.fixture(scope="module")
def network():
    return quality_network.trained([t.encode() for t in corpus(250, 1)[0]], corpus(250, 1)[1])


def plain_pooled(network, text):
    """The forward pass of one text, written out."""
    blocks = max(2, -(-(len(text) + WIDTH) // BLOCK))
    data = [0] * WIDTH + list(text) + [0] * (blocks * BLOCK - len(text))
    same = [*[0] * WIDTH, *repeats(text), *[0] * (len(data) - len(text) - WIDTH)]
    rows = np.array([[*network.vectors[b], s] for b, s in zip(data, same)])
    means = [
        np.mean([np.maximum(rows[p : p + WIDTH].ravel() @ network.filters + network.offsets, 0) for p in range(k * BLOCK, (k + 1) * BLOCK, STRIDE)], 0)
        for k in range(blocks)
    ]
    return np.max([(a + b) / 2 for a, b in zip(means, means[1:])], 0)


TEXTS = [b"", b"a", b"one two two two", b"\xc3\xa9" * 300, b"x" * 56, b"x" * 57, b"a\tb b\nb  b " * 90, b"\x00" * 10]


def test_repeats():
    text = b"a a b  b\nb\tb c"
    assert [text[i : i + 1] for i in np.flatnonzero(repeats(text)) if text[i : i + 1].isalpha()] == [b"a", b"b", b"b"]
    assert not repeats(b"").any() and len(repeats(b"")) == 0 and not repeats(b"   ").any()


def test_the_network_computes_what_it_says(monkeypatch):
    network = Network.start()
    network.weights[:] = np.linspace(-1, 1, FILTERS)
    network.vectors[0] = 0.4
    found = network.pooled(*laid_out(TEXTS))
    expected = np.array([plain_pooled(network, text) for text in TEXTS])
    assert np.allclose(found, expected, atol=1e-5)
    whole = network.scores(TEXTS)
    monkeypatch.setattr(quality_network, "SLICE", BLOCK)
    monkeypatch.setattr(quality_network, "GROUP_BYTES", 100)
    assert np.allclose(network.scores(TEXTS), whole, atol=1e-6)


def test_gradients_are_those_of_the_loss():
    network, labels = Network.start(), np.array([1, 0, 1, 0, 1, 1, 0, 1], np.float32)
    for p in ("vectors", "filters", "offsets", "weights", "constant"):
        setattr(network, p, getattr(network, p).astype(float))

    def loss():
        p = 1 / (1 + np.exp(-(network.pooled(*laid_out(TEXTS)) @ network.weights + network.constant)))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    r = random.Random(3)
    for parameter, slope in zip(network.parameters(), network.gradients(TEXTS, labels)):
        for _ in range(6):
            at = tuple(r.randrange(n) for n in parameter.shape)
            if parameter is network.vectors:
                at = (r.choice([32, 97, 98, 120, 195]), at[1])
            old = parameter[at]
            values = []
            for step in (1e-6, -1e-6):
                parameter[at] = old + step
                values.append(loss())
            parameter[at] = old
            assert slope[at] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-3, abs=1e-6)


def test_unseen_texts_are_told_apart(network):
    texts, good = corpus(300, 2)
    found = network.scores([t.encode() for t in texts]) >= quality_network.THRESHOLD
    assert (found == (good == 1)).mean() > 0.98


def test_junk_anywhere_in_a_long_text_is_seen(network):
    r = random.Random(4)
    long = prose(r, 20_000)
    assert network.scores([long.encode()])[0] > 0.7
    for at in (0, len(long) // 2, len(long)):
        assert network.scores([(long[:at] + " " + "an$$$ the$$$ ing$$$ " * 20 + long[at:]).encode()])[0] < 0.7


def test_tables(spark, network):
    texts, good = corpus(80, 6)
    docs = spark.createDataFrame([(i, t, "s", 1, "g", 0.5) for i, t in enumerate(texts)] + [(None, None, "s", 1, "g", 0.5), (None, "", "", 1, "", 0.5), (3, texts[3], "", 1, "", 0.5)], SCHEMA)
    labels = [(i, int(g), 0, "t") for i, g in enumerate(good)]
    # Labels that disagree, null labels and ids, and labels without a document.
    labels += [(0, 1 - int(good[0]), 0, "t"), (0, int(good[0]), 0, "t"), (1, None, 0, "t"), (None, 0, 0, "t"), (10**6, 0, 0, "t")]
    fitted = quality_network.fit(docs, spark.createDataFrame(labels, LABELS))
    found = quality_network.scored(docs.drop("score"), fitted).collect()
    assert len(found) == docs.count() and all(0 <= row.score <= 1 for row in found)
    assert np.ptp([row.score for row in found if not row.text]) < 1e-6
    assert np.ptp([row.score for row in found if row.doc_id == 3]) < 1e-6
    again = quality_network.fit(docs.repartition(5), spark.createDataFrame(labels[::-1], LABELS))
    assert all(np.array_equal(a, b) for a, b in zip(fitted.parameters(), again.parameters()))


def test_the_sample_is_bounded_and_leaves_held_out_rows_alone(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)] + [(7, "y" * 100)] * 300 + [(8, "z" * 100_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0, "t") for i in range(200)], LABELS)
    rows = quality_network.labelled(docs, labels, 60, 5000).collect()
    assert 0 < len(rows) <= 50 and sum(len(row.text) for row in rows) <= 5000
    every = quality_network.labelled(docs, labels, 10_000, 10**7).select("h").distinct()
    held_out = spark.range(200).withColumnRenamed("id", "doc_id").filter(quality_network.bucket() == 2).selectExpr("xxhash64(doc_id) as h")
    assert every.count() == 200 - held_out.count() and every.join(held_out, "h").count() == 0


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(i, "one two") for i in range(20)], "doc_id bigint, text string")
    none = spark.createDataFrame([], LABELS)
    good = spark.createDataFrame([(i, 1, 0, "t") for i in range(20)], LABELS)
    for labels, score in ((none, 0.0), (good, 1.0)):
        found = quality_network.scored(docs, quality_network.fit(docs, labels)).collect()
        assert [row.score for row in found] == [score] * 20
    assert quality_network.scored(docs.limit(0), quality_network.fit(docs.limit(0), good)).count() == 0


def test_registered_query(spark):
    found = {row.doc_id: row for row in QUERIES["op11_quality_classifier"](spark, SF_DIR).collect()}
    ids = {row.doc_id for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
    assert set(found) == ids and all(row.predicted == int(row.score >= 0.7) and 0 <= row.score <= 1 for row in found.values())
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality is not null").collect()
    held_out = [(row.quality, found[row.doc_id].predicted) for row in labels if row.doc_id in found and found[row.doc_id].held_out]
    assert held_out and np.mean([a == b for a, b in held_out]) > 0.9
