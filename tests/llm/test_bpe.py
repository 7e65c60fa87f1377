import hashlib
import random

import public_tokenizers as P
import pytest

from tapeworks.llm import bpe
from tapeworks.llm.queries import queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["the", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "r", "e", "don't", "é", "ß", "日本", "１２", "12", "3", "!", "...", "\t", " ", " ", "\x1c", "\x85", "a", "ing", "🙂", "$#", "_"]


def whole(text):
    return bpe.encoding(PATH, P.PATTERN).encode_ordinary(text)


@pytest.mark.parametrize("leaf", [2, 3, 7, 40])
def test_tree_is_whole(leaf):
    rng = random.Random(leaf)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
        tree = bpe.Tree(bpe.encoding(PATH, P.PATTERN), leaf, 1 + leaf // 4)
        ids = tree.encode(text)
        assert ids == whole(text), repr(text)
        assert tree.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["x" * 5000, " " * 5000, "a b" * 3000, "日本語" * 2000, "!" * 999 + " ", "'stuff" * 900, "7" * 4000])
def test_long_runs(text):
    assert bpe.Tree(bpe.encoding(PATH, P.PATTERN), 64, 16).encode(text) == whole(text)


@pytest.mark.parametrize("letters", ["etaoinshr", "日本語文字列漢的一是不了人", "абвгдеж"])
def test_bounded_windows_without_blanks(letters):
    rng = random.Random(7)
    text = "".join(rng.choice(letters) for _ in range(20_000))
    tree = bpe.Tree(bpe.encoding(PATH, P.PATTERN))
    assert tree.encode(text) == whole(text)
    assert tree.joins >= 64 and tree.widest <= 512


def test_most_documents_have_joins(spark, sf):
    tree, joined, rows = bpe.Tree(bpe.encoding(PATH, P.PATTERN)), 0, spark.read.parquet(f"{sf}/documents.parquet").collect()
    for r in rows:
        tree.joins = 0
        tree.encode(r.text or "")
        joined += tree.joins > 0
    assert joined > 0.8 * len(rows)


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_operator(spark):
    rows = [(1, "Hello there", 7), (2, None, 8), (None, "", 9), (2, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((bytes(r.decoded), len(r.ids)) for r in out) == sorted(((t or "").encode(), len(whole(t or ""))) for _, t, _ in rows)
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH, r"\S+")


def test_query(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = whole(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = queries()["op1_bpe_roundtrip"](spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
