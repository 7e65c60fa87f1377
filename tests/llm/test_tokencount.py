import random

import public_tokenizers as P

from tapeworks.llm import tokencount as T
from tapeworks.llm.queries import queries

PATH = P.path("byte_bpe_50k.json")


def whole(text):
    return len(T.tokenizer(PATH).encode(text, add_special_tokens=False))


def test_parts_add_up(spark):
    rng = random.Random(2)
    parts = ["the", " ", "  ", "\n", "'s", "é", " ", "<|endoftext|>", "<|endo", "\x1c", "\x85", "12", "!!", "日本", "\t", " a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "x" * 3000, "a " * 5000, texts[0]]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in T.count_tokens(docs, PATH).collect():
        t = texts[r.doc_id] or ""
        n = whole(t)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512), repr(t)


def test_batches():
    parts = [b"abc", b"", b"x" * 50, b"hello world"]
    assert T.lengths(parts, PATH, 1) == T.lengths(parts, PATH) == [whole(p.decode()) for p in parts]
    rng = random.Random(1)
    sizes = [rng.randrange(1, 2000) for _ in range(500)] + [9000]
    held = [sum(sizes[lo:hi]) for lo, hi in T.balanced(sizes, 5000)]
    assert sum(held) == sum(sizes) and all(h <= 5000 or h == 9000 for h in held)
    assert min(held[:-2]) > 0.5 * 5000 and T.balanced([], 10) == []


def test_long_texts():
    rng = random.Random(3)
    parts = ["the ", "word  ", "é ", "\u3000 ", "日本", "\n ", "x" * 30 + " ", "<|endoftext|>"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(200))).encode()
        got = T.pieces(text, 64)
        assert b"".join(got) == text and sum(T.lengths(got, PATH)) == whole(text.decode())
    assert T.pieces(b"x" * 1000, 64) == [b"x" * 1000] and len(T.pieces(b"ab " * 1000, 64)) > 40


def test_empty(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query(spark, sf):
    want = {r.doc_id: whole(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries()["op9_token_counts"](spark, sf).collect()} == want
