import re
from html import unescape

import pytest

from tapeworks.llm.html import extract, main_text
from tapeworks.llm.queries import queries

LONG = "Some words of a long enough paragraph, which tells the reader what there is to know about it."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a &amp; b<script>var x='</p>';</script> c", "a & b c"),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{LONG}<p>short<br>er &lt;x&gt;</article><footer>f</footer>", f"T\n{LONG}\nshort er <x>"),
        (f"<header><h2>Site</h2></header><main><header><h1>T</h1></header><p>{LONG}</p></main><aside>side</aside>", f"T\n{LONG}"),
        (f'<div class="menu"><a>x</a></div><div><p>{LONG}</p><div class="ad">buy</div><p>{LONG}</p></div><div id=comments><p>{LONG} no</p></div>', f"{LONG}\n{LONG}"),
        (f"<!-- <p>no</p> --><div><p title='a>b'>{LONG}</p><form><input>x</form><p>y</p></div>", f"{LONG}\ny"),
        (f"<p>{LONG}<p style='display:none'>hidden<p>after 1 < 2", f"{LONG}\nafter 1 < 2"),
        ("<style>p{}</style><title>t</title>", ""),
        ("<div>" * 3000 + "deep", "deep"),
        (f"<div class='wrap sidebar-left'><article><p>{LONG}</p><p><a>{LONG}</a></p></article><div class=sidebar>no</div></div>", f"{LONG}\n{LONG}"),
        (f"<div class='has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>{LONG}</p></article><article class=comment><p>{LONG} no</p></article>", f"{LONG}\n{LONG}"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_operator(spark):
    rows = [(1, "u", "<p>x</p>", "old"), (None, None, None, None), (1, "u", "<p>x</p>", "old")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("x", 1), ("x", 1)]


def test_query(spark, sf):
    """Against the article element of these pages, cut out with regular expressions."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries()["op4_html_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)
