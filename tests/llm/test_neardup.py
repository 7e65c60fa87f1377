import random

import numpy as np
import pytest

from tapeworks.llm import nearlinks
from tapeworks.llm.common import connected
from tapeworks.llm.neardup import near_duplicates
from tapeworks.llm.queries import queries

from .data import SCHEMA, components, edited, near_rows, shingle_set, words


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    want = components(sets)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_brute_force(spark):
    check(spark.createDataFrame(near_rows(), SCHEMA))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_chunks(spark, monkeypatch):
    """Hot buckets and groups, cut into many chunks, give the same classes."""
    monkeypatch.setattr(nearlinks, "SIGNATURES", 3)
    monkeypatch.setattr(nearlinks, "SETS", 2)
    check(spark.createDataFrame(near_rows(5), SCHEMA))


def test_one_group_of_many_near_copies(spark):
    """Rows that go into blocks grow with a group, not with its square: nearly all members are joined with the first one."""
    rng = random.Random(11)
    base = words(rng, 60, 5000)
    rows = [(i, " ".join(edited(rng, base, 1) if i else base)) for i in range(3000)] + [(5000 + i, " ".join(words(rng, 60, 5000))) for i in range(50)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 + i for i in range(50)}


@pytest.mark.parametrize("seed", range(3))
def test_estimate(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    sig = nearlinks.packed(nearlinks.minima([a, b]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(float(nearlinks.estimate(sig[0], sig[1])) - true) < 0.2


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in (1, 5, 50, 200, 250, 3, 90, 40, 41, 42)]
    got = nearlinks.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 4)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = components({r.doc_id: shingle_set(r.text) for r in docs})
    got = {r.doc_id: r.component_id for r in queries()["op2_near_duplicates"](spark, sf).collect()}
    assert got == want
