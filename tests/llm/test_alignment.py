import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from conftest import SF_DIR
from tokenizers import Tokenizer

from cardlake.llm import alignment
from cardlake.llm.byte_bpe import byte_letters
from cardlake.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, row string, links int, n_best double, pair string"
PARTS = ["a", "the", "Straße", "naïve", " ", "  ", "\n", "\t", "'re", "!", "日本", "😀", "1234", "<|endoftext|>", "</s>", "<s>", "<0x41>", "\xa0",
         "x" * 500, " " * 450, "\x1c", "​", "internationalisation", "ﬁ", "\x00"]


class Brute:
    """Groups as connected components of overlapping tokens, by the two vocabularies' own libraries."""

    def __init__(self):
        letters = byte_letters()
        with open(alignment.BYTE_VOCABULARY, encoding="utf-8") as source:
            vocab = json.load(source)["model"]["vocab"]
        self.a = Tokenizer.from_file(alignment.BYTE_VOCABULARY)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
        self.a_bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if not token.startswith("<|endof")}

    def piece(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def groups(self, text):
        """(groups of ids of A and B, links as pairs of ids)."""
        if not text:
            return [], []
        data = b" " + text.encode()
        sides = []
        for ids, of in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes.__getitem__), (self.b.encode(text), self.piece)):
            at, tokens = 0, []
            for i in ids:
                tokens.append((at, at + len(of(i)), i))
                at += len(of(i))
            if b"".join(of(i) for i in ids) != data:
                return [], []
            sides.append(tokens)
        pairs = [(i, j) for i, (s, e, _) in enumerate(sides[0]) for j, (t, f, _) in enumerate(sides[1]) if s < f and t < e]
        root = {("a", i): ("a", i) for i in range(len(sides[0]))} | {("b", j): ("b", j) for j in range(len(sides[1]))}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in pairs:
            root[find(("a", i))] = find(("b", j))
        members = {}
        for x in sorted(root):
            members.setdefault(find(x), ([], []))[x[0] == "b"].append(x[1])
        ordered = sorted(members.values())
        return (
            [([sides[0][i][2] for i in a], [sides[1][j][2] for j in b]) for a, b in ordered],
            [(sides[0][i][2], sides[1][j][2]) for i, j in pairs],
        )

    def table(self, texts):
        """The contract's columns for every text."""
        found = [self.groups(text) for text in texts]
        counts = Counter(pair for _, links in found for pair in set(links))
        highest = {}
        for (a, _), n in counts.items():
            highest[a] = max(n, highest.get(a, 0))
        rows = []
        for groups, links in found:
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            rows.append((
                sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                sum(counts[pair] == highest[pair[0]] for pair in links), sum(counts[pair] for pair in links),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            ))
        return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def brute():
    return Brute()


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 9))) for _ in range(n)]


def test_pointer_jumping_finds_the_ends_of_chains():
    chain = np.append(np.arange(1, 1000), 999)
    assert (alignment.terminals(chain) == 999).all()
    assert alignment.terminals(np.array([1, 1, 3, 3])).tolist() == [1, 1, 3, 3]
    assert not len(alignment.terminals(np.empty(0, np.int64)))


@pytest.mark.parametrize("most", [0, 40, alignment.FREQUENT])
def test_a_table_as_by_brute_force(spark, brute, monkeypatch, most):
    """With no, some and all pairs in the broadcast table."""
    some = [None, "", "▁", "a▁b", " ", "word " * 3000, "long" * 3000, *texts(120), *texts(20)]
    docs = spark.createDataFrame([(i if i != 9 else None, text, "r", 1, 0.5, "p") for i, text in enumerate(some)], SCHEMA).repartition(3)
    found = alignment.with_counts(alignment.stored(alignment.links(docs), "links"), most).collect()
    assert len(found) == len(some)
    expected = brute.table(some)
    for r in found:
        assert tuple(r[c] for c in COLUMNS) == expected[9 if r.doc_id is None else r.doc_id]


def test_rows_that_repeat_count_as_documents(spark, brute):
    some = ["one two", "one two", "one three", None, None]
    docs = spark.createDataFrame([(7, text) for text in some], "doc_id bigint, text string")
    found = sorted(tuple(r[c] for c in COLUMNS) for r in alignment.aligned(docs).collect())
    assert found == sorted(brute.table(some))


def test_groups_of_tokens(spark, brute):
    some = texts(60, 3)
    found = {r.doc_id: r for r in alignment.groups(spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(some):
        r, (groups, _) = found[i], brute.groups(text)
        assert [([x for x, g in zip(r.a_ids, r.a_groups) if g == k], [x for x, g in zip(r.b_ids, r.b_groups) if g == k]) for k in range(len(groups))] == groups
        assert not r.a_groups or max(r.a_groups) == len(groups) - 1


def test_least_frequent_keeps_the_bound(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [5] * 10 + [100, 100, 3000])], "pair bigint, n bigint")
    for most, least in ((0, 2**62), (1, 3000), (2, 3000), (3, 100), (13, 5), (1000, 1)):
        assert alignment.least_frequent(counts, most) == least
        assert counts.filter(f"n >= {least}").count() <= most


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA)).count() == 0
    assert alignment.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registered_query(spark, brute):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    short = {i: text for i, text in rows.items() if len(text or "") < 3000}
    found = QUERIES["op13_alignment"](spark, SF_DIR).collect()
    assert {r.doc_id for r in found} == set(rows)
    for r in found:
        if r.doc_id in short:
            groups, links = brute.groups(short[r.doc_id])
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            assert (r.n_groups, r.n_links) == (len(groups), len(links))
            assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
