import re

import duckdb
import pytest

from tapeworks.llm import urlfilter as U
from tapeworks.llm.queries import oracle_sql, queries

URLS = [
    None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://A.ORG/x?y#z", "http://org/", "http://xorg/", "https://example.org/es/1", "http://m.example.org/en/12", "http://notexample.org/es/1",
    "http://a.com/fr/x", "http://a.com/de/x", "http://a.com/?u=http://b.org/", "http://a.net/casino", "http://a.net/CASINO?x", "http://a.net/casinos", "http://ads.b.net/1", "http://ads1.b.net/1", "http://b.net/tag/x/page/2", "http://b.net/a\nb", "x://É.org/é#f", "http://b.net/wp-json/",
]


def expected(url, rules=U.PATTERN_RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fit = [(h + p, v) for h, p, v in U.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, None)
    if not verdict:
        verdict = "block" if any(re.search(x, (url or "").lower()) for _, _, x in rules) else "allow"
    return host, path, rule, verdict


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)] + [(None, URLS[9], "c")], "page_id long, url string, verdict string")
    got = U.filter_urls(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == expected(r.url), r.url


def test_index_misses_nothing():
    """Each match of a rule holds all its tokens."""
    for _, tokens, regex in U.PATTERN_RULES:
        for u in filter(None, URLS):
            if re.search(regex, u.lower()):
                assert set(tokens) & set(re.split(r"[\W_]+", u.lower()))


def test_bounds(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(pages).collect() == []
    assert U.filter_urls(pages, pattern_rules=[]).collect() == []
    with pytest.raises(ValueError):
        U.filter_urls(pages, pattern_rules=[("x", [], "x")])


def test_rules_as_a_table(spark):
    """Rules beyond the literals are joined, with the same result; and a table of more rules than may be literals."""
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(99, URLS[15])], "page_id long, url string")
    rows = lambda **kw: sorted(map(tuple, U.filter_urls(pages, **kw).collect()), key=str)
    assert rows(literals=0) == rows()
    many = [(f"r{i}", [f"t{i}"], rf"/t{i}/") for i in range(5000)]
    urls = spark.createDataFrame([("http://a.net/t4321/",), ("http://a.net/t4321",), ("http://a.net/x/t7/t5/",)], "url string")
    assert sorted((r.url, r.pattern, r.verdict) for r in U.filter_urls(urls, pattern_rules=many).collect()) == [("http://a.net/t4321", None, "allow"), ("http://a.net/t4321/", "r4321", "block"), ("http://a.net/x/t7/t5/", "r5", "block")]


def test_native(spark, sf):
    df = queries()["op10_url_filters"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracle_sql()['op10_url_filters']})").fetchall()
    assert sorted(map(tuple, queries()["op10_url_filters"](spark, sf).collect())) == sorted(want)
