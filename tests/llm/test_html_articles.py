import pytest

from tapeworks.llm.html import main_text

LONG = "Some words of a long enough paragraph, which tells the reader what there is to know about it."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<article><div class="elementor-widget elementor-widget-text-editor"><p>{LONG}</p><p>{LONG}</p></div></article>', f"{LONG}\n{LONG}"),
        (f'<main><p>{LONG}</p><section id="social-science"><h2>Title</h2><p>{LONG}</p></section></main>', f"{LONG}\nTitle\n{LONG}"),
        (f'<article><p>{LONG}</p><p>a <span class="notice">word</span> in it</p></article>', f"{LONG}\na word in it"),
        (f'<article><p>{LONG}</p><div class="ad">buy</div><div class="share"><a>{LONG}</a></div><p>{LONG}</p></article>', f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><h2>Sources</h2><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></article>", f"{LONG}\nSources\nOne\nTwo\nThree"),
        (f"<article><p>{LONG}</p><ul><li><a>A linked reference</a><li><a>Another of them</a><li><a>And a third one</a></ul><p>{LONG}</p></article>", f"{LONG}\nA linked reference\nAnother of them\nAnd a third one\n{LONG}"),
        (f'<div class="widget"><p>{LONG}</p></div>', LONG),
    ],
)
def test_parts_of_articles(html, text):
    assert main_text(html) == text


def test_wrapped_pages():
    body = "<h1>Title</h1><p>" + "a sentence of the article. " * 20 + "</p><p>" + "and one more of them. " * 20 + "</p>"
    want = main_text(f"<body><div>{body}</div></body>")
    assert want.startswith("Title\na sentence")
    for wrapped in (f"<form>{body}</form>", f"<div class='search-page'>{body}</div>", f"<div id='related'>{body}</div>", f"<div class='search'><form action=x>{body}</form></div>"):
        assert main_text(f"<body>{wrapped}</body>") == want, wrapped[:40]


def test_open_words_without_an_article():
    text = "a sentence of the page that is long enough to count. " * 12
    section = "<section class='related-work'><h2>Related work</h2><p>" + "what others have done about the same thing before. " * 12 + "</p></section>"
    links = "<div class='related-posts'><ul>" + "".join(f"<li><a href=/{i}>Another post number {i}</a></li>" for i in range(6)) + "</ul></div>"
    got = main_text(f"<body><div><p>{text}</p>{section}{links}</div></body>")
    assert "what others have done" in got and "Related work" in got and "Another post" not in got
