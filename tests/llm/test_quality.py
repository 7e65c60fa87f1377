import math
import random
import re
from collections import Counter

import xxhash  # noqa: F401

from tapeworks.llm import quality as Q
from tapeworks.llm.queries import queries

from .data import words


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    hit = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_rules(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "# $a b\n日本 | <é>", "\x0b\x0c\r"]
    texts += [" ".join(words(rng, n, 12)) for n in (3, 10, 60, 400, 3000)] + [" ".join(words(rng, 200, 100000))]
    texts += ["one two three four " * 3000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a b", "x")], "doc_id long, text string, llr string")
    labels = spark.createDataFrame([(10, 1, 0), (11, 1, None), (3, 0, 1), (None, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality(docs, labels).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = base(r.text)
        assert tuple(r[c] for c in COUNTS) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, " ".join(words(random.Random(4), 80, 10**6)))], "doc_id long, text string")
    (r,) = Q.quality(docs, none).collect()
    assert r.kept and r.llr == 0
    assert Q.quality(docs.limit(0), none).collect() == []


def test_ratio(spark):
    """The score against the same sums over plain counts of the buckets that Spark gives."""
    docs = spark.createDataFrame([(1, "a b c a"), (2, "a b d"), (3, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    grams = {r.doc_id: [b for b in r.g if b is not None] for r in Q.with_hashes(docs).select("doc_id", Q.grams(64).alias("g")).collect()}
    raw, good = Counter(b for g in grams.values() for b in g), Counter(grams[1])
    weight = lambda b: math.log((good[b] + 1) / (sum(good.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64))
    for r in Q.quality(docs, labels, buckets=64).collect():
        assert math.isclose(r.llr, sum(map(weight, grams[r.doc_id])) / len(grams[r.doc_id]), abs_tol=1e-12)


def test_every_trusted_document_counts(spark):
    """More trusted rows than the 20,000 that once were the most, by both kinds of join."""
    docs = spark.range(20_500).selectExpr("id as doc_id", "concat('a b ', id) as text").union(spark.createDataFrame([(None, "n n"), (7, "a b 7")], "doc_id long, text string"))
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    # Each row with an id is trusted, the one without isn't, so both counts differ by its two words and one pair.
    grams = {r.text: [b for b in r.g if b is not None] for r in Q.with_hashes(docs).select("text", Q.grams(64).alias("g")).collect()}
    raw = Counter(b for t in grams for b in grams[t]) + Counter(grams["a b 7"])
    good = raw - Counter(grams["n n"])
    weight = lambda b: math.log((good[b] + 1) / (good.total() + 64)) - math.log((raw[b] + 1) / (raw.total() + 64))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        got = Q.quality(docs, labels, buckets=64).where("doc_id % 1000 = 0 or doc_id = 7 or doc_id is null").collect()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert len(got) == 24
        for r in got:
            assert math.isclose(r.llr, sum(map(weight, grams[r.text])) / len(grams[r.text]), abs_tol=1e-12)


def test_query(spark, sf):
    got = {r.doc_id: r for r in queries()["op3_quality_rules"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(tuple(got[r.doc_id][c] for c in COUNTS) == base(r.text) for r in docs)
