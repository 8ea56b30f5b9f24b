import random

import numpy as np
import pytest

from cardlake.llm import toxicity

DOCS = "doc_id bigint, text string, score string, toxic string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus():
    r = random.Random(6)
    syllables = ["na", "ri", "to", "me", "sol", "ka", "den", "vi", "lo", "pan"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(1200):
        words = [word() for _ in range(r.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grubber", "wuzzock", "fleth" + r.choice(syllables)]))
        docs.append((i, " ".join(words), "s", "t", "xx"))
        labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DOCS)
    return frame, toxicity.fit(frame, spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], LABELS))


def test_held_out_documents(spark, fitted):
    frame, classifier = fitted
    rows = toxicity.scored(frame.withColumn("held_out", toxicity.bucket() == 2), classifier, "found").filter("held_out").collect()
    right = [(r.found >= 0.3) == (r.doc_id % 6 == 0) for r in rows]
    assert len(rows) > 200 and sum(right) / len(right) > 0.97


def test_obfuscated_words_score_as_plain_ones(fitted):
    _, classifier = fitted
    rest = "soltome vidennari kapan lo "
    assert classifier.score(rest) < 0.3
    for bad in ("grubber wuzzock", "gru88er wuzz0ck", "g r u b b e r w u z z o c k", "g.r.u.b.b.e.r w-u-z-z-o-c-k", "gruuuubber wuzzzzock", "Grubber!!! WUZZOCK"):
        assert classifier.score(rest + bad) >= 0.3, bad


def test_separators_inside_words_and_short_fragments(fitted):
    _, classifier = fitted
    rest = "soltome vidennari kapan lo "
    for bad in ("gru.bber wuz-zock", "grub_ber wuz'zock", "gr-ub-ber wu-zzo-ck", "gru bber wuz zock", "g rub ber wu z zock", "gru8 ber, wuz\nz0ck", "gru-b ber wuz. zock!!"):
        assert classifier.score(rest + bad) >= 0.3, bad
    for clean in ("sol-tome viden-nari", "kapan_lo ri'na", "sol to me vi den na ri ka pan lo", "a-b-c d. e, 1-2 3 4", "sol! to! me! " * 50):
        assert classifier.score(rest + clean) < 0.3, clean


def test_separators_are_dropped_where_the_channel_says_so(fitted, monkeypatch):
    joiner = toxicity.Joiner(fitted[1].model)
    texts = ["id.iot", "clo_wn 2024 an i d", "one", "", "!!! 1 2 3", "a b\nc", "x\0y z", "gru8 ber", "$$$ b c", "é à"]
    monkeypatch.setattr(toxicity, "DROPPED_BLANK", 500.0)
    monkeypatch.setattr(toxicity, "DROPPED_MARK", 500.0)
    assert joiner.words(texts) == [["idiot"], ["clown", "anid"], [], [], [], ["abc"], ["yz"], ["gru8ber"], ["bc"], ["éà"]]
    assert joiner.words(["na " * 100_000])[0] == ["na" * 100_000] and joiner.words([]) == []
    monkeypatch.setattr(toxicity, "DROPPED_BLANK", -500.0)
    assert joiner.words(texts) == [["idiot"], ["clown"], *[[]] * 8]


def test_the_language_model_decides_between_border_and_dropped(spark):
    """"qu" is never apart, and no word begins with "u"; "na" and "ri" are words."""
    docs = spark.createDataFrame([(i, "quna na ri riqu na", "s", "t", "x") for i in range(50)], DOCS)
    joiner = toxicity.Joiner(toxicity.language_model(docs))
    assert joiner.words(["na q una ri", "na q.una", "na ri na"]) == [["quna"], ["quna"], []]


def test_restoration(fitted):
    restorer = toxicity.Restorer(fitted[1].model)
    assert restorer.words("gru88er") == ["grubber"]
    assert restorer.words("w.u.z.z.0.c.k") == ["wuzzock"]
    assert restorer.words("solll") in (["sol"], ["soll"])
    assert restorer.words("Plain,") == ["plain"] and restorer.words("two-words") == ["two", "words", "twowords"]
    assert restorer.words("2024") == [] and restorer.words("%%%") == []


def test_other_texts_get_scores(spark, fitted):
    _, classifier = fitted
    rows = [(1, None, "s", "t", "x"), (2, "", "s", "t", "x"), (None, "日本 语", "s", "t", "x"), (4, "na " * 100_000, "s", "t", "x"), (4, "na " * 100_000, "s", "t", "x"), (5, "!!! @@@ 1 2 3 4", "s", "t", "x")]
    found = toxicity.scored(spark.createDataFrame(rows, DOCS), classifier, "found")
    assert found.columns == ["doc_id", "text", "score", "toxic", "lang", "found"]
    assert all(0 <= r.found < 0.3 for r in found.collect())
    assert toxicity.scored(spark.createDataFrame([], DOCS), classifier, "found").count() == 0


def test_without_usable_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame(corpus()[0][:50], DOCS)
    for labels in ([], [(1, 1, 0), (2, 0, None)]):
        kept = toxicity.harmless(docs, spark.createDataFrame(labels, LABELS))
        assert kept.count() == 50 and kept.columns == docs.columns


def test_the_language_model_counts_all_documents(spark):
    docs = spark.createDataFrame([(i, "ab", "s", "t", "x") for i in range(30)] + [(99, "ac", "s", "t", "x")], DOCS).repartition(7)
    model = toxicity.language_model(docs)
    a, b, c = 1, 2, 3
    assert model[0][a][b] > model[0][a][c] + 2
    assert model.shape == (toxicity.CLASSES,) * 3


def test_common_words_stay_known_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED", 3)
    reader = toxicity.Reader(np.log(np.full((28, 28, 28), 1 / 28)), lambda hashes, per_token: per_token.tolist())
    restore, calls = reader.restorer.words, []
    reader.restorer.words = lambda token: calls.append(token) or restore(token)
    texts = [f"c0mmon x{i}y" for i in range(10, 18)]
    found = [sorted(values) for text in texts for values in reader.read([text])]
    assert calls.count("c0mmon") == 1
    fresh = toxicity.Reader(np.log(np.full((28, 28, 28), 1 / 28)), lambda hashes, per_token: per_token.tolist())
    assert found == [sorted(values) for values in fresh.read(texts)]
