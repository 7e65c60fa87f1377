"""Every operator with columns whose names are those that it uses itself, and with odd rows."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from tapeworks.llm import bpe, html, linededup, neardup, ngramlm, passages, quality, tokencount, urlfilter, wumanber

NAMES = ["_id", "_key", "_ps", "_gone", "_row", "_any", "_words", "_h", "_q", "_fetched", "_rule", "in", "e", "k", "p", "at", "c0", "c1", "o0", "key", "kind", "found", "fetched", "row", "new_text", "gone", "url2", "Lang", "rep", "component", "id", "n", "h1", "i"]
EXTRA = ", ".join(f"`{n}` string" for n in NAMES)
LONG = "\n".join(f"line {i} of a very long text, number {i * 7}" for i in range(4000))
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (4, "a b c"), (None, "x y"), (5, LONG), (6, LONG), (7, "one\ntwo\nthree\nfour\n" * 3)]


def labels(spark):
    return spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([("i", "line 5 of a very"), (None, "x"), ("j", None)], "item_id string, text string")


BPE = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
KEEP = {
    "bpe": lambda s, d: bpe.encode(d, *BPE),
    "quality": lambda s, d: quality.quality(d, labels(s)),
    "passages": lambda s, d: passages.dedup_passages(d),
    "lines": lambda s, d: linededup.dedup_lines(d),
    "search": lambda s, d: wumanber.find_items(d, items(s)),
    "search in blocks": lambda s, d: wumanber.find_items(d, s.createDataFrame([("i", "line 5 of a very"), ("k", "a b c")], "item_id string, text string"), budget=2),
}
PICK = {
    "round trip": lambda s, d: bpe.round_trip(d, *BPE),
    "near duplicates": lambda s, d: neardup.near_duplicates(d),
    "counts": lambda s, d: tokencount.count_tokens(d, P.path("byte_bpe_50k.json")),
    "scores": lambda s, d: ngramlm.score_documents(d),
}


def docs(spark, rows=TEXTS, text="text"):
    return spark.createDataFrame([(d, t, *NAMES) for d, t in rows], f"doc_id long, {text} string, {EXTRA}")


@pytest.mark.parametrize("name", KEEP)
def test_own_columns_stay(spark, name):
    df = docs(spark)
    out = KEEP[name](spark, df.repartition(3))
    assert out.columns[: len(df.columns)] == df.columns
    rows = out.collect()
    assert len(rows) == len(TEXTS) and all(tuple(r[2 : len(NAMES) + 2]) == tuple(NAMES) for r in rows)
    assert KEEP[name](spark, df.limit(0)).collect() == []


@pytest.mark.parametrize("name", PICK)
def test_other_columns_do_not_matter(spark, name):
    rows = PICK[name](spark, docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in TEXTS)
    plain = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert sorted(map(str, rows)) == sorted(map(str, PICK[name](spark, plain).collect()))
    assert PICK[name](spark, docs(spark).limit(0)).collect() == []


def test_a_text_column_of_another_case(spark):
    for name in ("lines", "passages", "search", "quality"):
        out = KEEP[name](spark, docs(spark, text="Text"))
        assert out.columns[1] == "Text" and out.count() == len(TEXTS)


def test_pages(spark):
    extra = [n for n in NAMES if n not in ("id", "n")]
    schema = "page_id long, url string, html string, " + ", ".join(f"`{n}` string" for n in extra)
    rows = [(1, None, None), (2, "", ""), (3, "http://a.org/x", "<article><p>a</p></article>"), (3, "http://a.org/x", "<article><p>a</p></article>"), (None, "http://casino.net/casino", "<p>" + "word " * 50_000), (5, "x" * 100_000, "<" * 50_000)]
    pages = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    for f in (html.extract, urlfilter.filter_urls):
        out = f(pages)
        got = out.collect()
        assert len(got) == len(rows) and all(r[extra[0]] == extra[0] and r["in"] == "in" and r["_rule"] == "_rule" for r in got)
        assert f(pages.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, tmp_path, k):
    """Each stage on odd rows, an empty table and clashing columns."""
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    names = [n for n in NAMES if n != "n_chars"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names if n != "Lang")
    own = [n for n in names if n != "Lang"]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *own) for d, t in TEXTS], schema)
    out = stage(spark, df, str(tmp_path))
    rows = out.collect()
    if k < 4:
        assert out.columns == df.columns and all(r["_id"] == "_id" for r in rows)
    assert {r.doc_id for r in rows} <= {d for d, _ in TEXTS}
    assert stage(spark, df.limit(0), str(tmp_path)).collect() == []
    if name == "near dedup":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "4", "5", "7", "None"]
    if name == "decontamination":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, None, 7}
