import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeworks.llm import ngramlm as L
from tapeworks.llm.eliasfano import Sequence, from_buffer, sequence, to_bytes
from tapeworks.llm.queries import queries

from .data import words


@pytest.mark.parametrize(("n", "universe"), [(0, 5), (1, 1), (1, 1 << 62), (7, 8), (500, 600), (500, 1 << 40), (3000, 1 << 62), (2000, 1 << 20)])
def test_sequence(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.choice(universe, n, replace=False) if universe < 10**4 else np.unique(rng.integers(0, universe, n)))
    s = sequence(from_buffer(to_bytes(Sequence.build(values, universe).parts("x"))), "x")
    assert s.n == len(values)
    if len(values):
        assert (s.get(np.arange(len(values))) == values.astype(np.uint64)).all()
        assert (s.find(values.astype(np.uint64)) == np.arange(len(values))).all()
        absent = np.setdiff1d(rng.integers(0, universe, 500), values).astype(np.uint64)
        assert (s.find(absent) == -1).all()


def expected(rows, mu=L.MU):
    """Counts of plain tuples; contexts grow one word at a time up to len(mu) words."""
    train = [(i, t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    uni, grams = Counter(), Counter()
    for _, t in train:
        w = [*(t or "").encode().lower().split(), "END"]
        uni.update(w)
        x = ["BEGIN", *w]
        for k in range(2, len(mu) + 2):
            grams.update(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    n, v = sum(uni.values()), len(uni)

    def seen(c):
        return len(train) if c == ("BEGIN",) else uni[c[0]] if len(c) == 1 else grams[c]

    out = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "END"]
        unit = {y: (uni[y] + 1) / (n + v + 1) for y in w}
        x, score = ["BEGIN", *w], 0.0
        for at in range(1, len(x)):
            p = unit[x[at]]
            for k in range(1, min(len(mu), at) + 1):
                c = tuple(x[at - k : at])
                p = (grams[(*c, x[at])] + mu[k - 1] * p) / (seen(c) + mu[k - 1])
            score += math.log10(p)
        out.append((i, len(w), sum(uni[y] > 0 for y in w), n, sum(math.log10(unit[y]) for y in w), score))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        assert math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g[5], w[5], rel_tol=5e-4, abs_tol=5e-3)


@pytest.mark.parametrize(("mu", "hot"), [(L.MU, L.HOT), (L.MU, 5), ((50.0,), 5), ((200.0, 20.0, 3.0), 5)])
def test_brute_force(spark, mu, hot):
    """Orders 2 to 4; with ``hot`` 5 frequent words are spread over shards."""
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randrange(80), 30))) for i in range(60)] + [(60, None), (61, ""), (62, "unseen Words ÉÉ"), (None, "a b"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    compare(L.score_documents(docs, mu=mu, hot=hot).collect(), expected(rows, mu))


def test_distinct_rows():
    """Keys that don't fit 63 bits give the same rows as those that do."""
    rng = np.random.default_rng(5)
    cols = [rng.integers(0, 9, 400) for _ in range(3)]
    rows, n, back = L.distinct(cols, 9, inverse=True)
    wide, m, there = L.distinct(cols, 1 << 22, inverse=True)
    assert all((a == b).all() for a, b in zip(rows, wide, strict=True))
    assert (n == m).all() and (back == there).all() and n.sum() == 400
    assert all((r[back] == c).all() for r, c in zip(rows, cols, strict=True))


def test_long_runs_of_a_bucket():
    """Buckets of more than 64 values end at the right place."""
    values = np.r_[np.arange(100), np.arange(10_000, 10_300), [1 << 20]].astype(np.uint64)
    s = Sequence.build(values, 1 << 22)
    assert (s.find(values) == np.arange(len(values))).all()
    assert (s.find(np.array([100, 9_999, 10_300, 1 << 21], np.uint64)) == -1).all()


def test_empty(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op6_lm_scores"](spark, sf).collect()
    compare(got, expected(rows))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
