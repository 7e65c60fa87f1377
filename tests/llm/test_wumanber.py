import random
import re

import pytest

from tapeworks.llm import wumanber as M
from tapeworks.llm.queries import queries

from .data import words


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, window=10):
    out = []
    pats = {}
    for i, t in items:
        w = words_of(t)
        n = min(window, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                pats.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    for d, t in docs:
        w = words_of(t)
        hit, found = set(), set()
        for p, owners in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), M.items_sha256(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [10**6, 25])
def test_brute_force(spark, budget):
    rng = random.Random(6)
    items = [("i1", " ".join(words(rng, 30, 9))), ("i2", "w1 w2"), ("i3", "W3"), ("i4", None), ("i5", "-- ,"), (None, "w4"), ("i1", "w8 w8 w8"), ("i6", "É é 7-w1")]
    docs = [(i, " ".join(words(rng, 200, 9))) for i in range(10)] + [(10, None), (11, ""), (12, "W1-w2,w2 w1"), (None, "x w3"), (12, items[0][1] + " w7 " + items[0][1]), (13, "é É 7 W1"), (13, "é É 7 W1")]
    d = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = M.digest(M.find_items(d, b, budget=budget)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(docs, items)


def test_no_items_or_documents(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = M.digest(M.find_items(d, b)).collect()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)
    assert M.find_items(d.limit(0), b).collect() == []


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries()["op7_decontamination"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(docs, items)
