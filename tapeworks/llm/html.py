"""Main text of web pages by composite text density.

A page is read into a tree of its block elements; inline elements only count as
tags.  Elements that are never article text (menus, page headers and footers,
sidebars, notices, adverts, forms, comments, scripts, styles, hidden parts) are
left out by element name, role, or a word of class or id.  Inside an article or main
element a word is not enough: the part goes if its text is mostly links or less than half
as dense as the article, and inline elements other than links stay; a few words that
articles' own parts have as well (``_OPEN``) are judged so everywhere.  Where words leave
nothing of a page they don't count, and where forms do, they are read.  For each node the
composite density is

    C / T * log_b(C * T / (LC * LT)),  b = ln(C * LC / (C - LC) + LC_body * C / C_body + e)

with C characters, T tags, LC characters in links and LT link tags (each at least
1).  The sum over a node's children finds the densest subtree.  The smallest
density on the path from the body to it is the threshold: every node at or above it
adds its own densest subtree, and the result is the smallest subtree below the
body that holds them all, or just them where only the body does.  Three or more
blocks in a row whose text is mostly links are a menu and left out; inside an article or
main element only if no heading stands before them and they are short (``LABEL``).

Character references are decoded, white space inside a block becomes one blank,
blocks are trimmed and joined by one line feed.  A null or empty page gives an
empty text; a page without a tag is one block.  Broken markup (unclosed or stray
tags, a ``<`` that begins no tag) is read as browsers do, as far as blocks go.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, extended

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
#: For what follows a tag that never ends: tags without a ``<`` inside, so that each is looked at once.
_LOOSE = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?/][^<>]*+>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")

#: Fixed values of the markup language, in alphabetical order.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes plaintext script style textarea title xmp".split())
_NEVER = frozenset("applet aside audio button canvas datalist dialog footer form head iframe map menu nav noembed noframes noscript object option select svg template textarea title video".split())
_NO_P = _BLOCKS - {"body", "html"}
#: An open element of the first kind ends when one of the second begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: Words of class, id or role that mark a part as not the article.
_NOISE = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())


#: Prefixes of class words that tell about the page's layout, not of the element itself.
_LAYOUT = ("has-", "with-", "no-", "is-", "without-")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters of a block, on average, from which linked blocks inside an article are a list and not a menu.
LABEL = 10
#: Words that articles' own parts have as well; outside an article element, too, they are judged by links and density.
_OPEN = frozenset("related search share sharing social widget widgets".split())
_READERS = frozenset("comment comments disqus replies reply".split())


class Node:
    __slots__ = ("name", "parent", "children", "text", "link", "tags", "link_tags", "chars", "link_chars", "density", "best", "most", "inside", "doubt")

    def __init__(self, name: str, parent: Node | None) -> None:
        self.name, self.parent = name, parent
        self.children: list = []  # nodes, and (text, in link) runs
        self.tags, self.link_tags = 1, 0
        self.chars = self.link_chars = 0
        self.density = 0.0
        self.best, self.most = self, -1.0
        self.inside = name in ("article", "main") or parent is not None and parent.inside
        self.doubt = False  # inside an article, with a class word of what is left out


def _noise(name: str, attrs: str, inside: bool, forms: bool = False) -> str:
    """Why an element is never article text, or "". inside: it stands in an article or main element; forms: they may be."""
    if name in _NEVER and not (forms and name in ("form", "fieldset")) or name == "header" and not inside:
        return "element"
    if not attrs or name in ("html", "body", "main"):
        return ""
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "hidden"
        if key in ("class", "id", "role"):
            words = {w for token in value.split() if not token.startswith(_LAYOUT) for w in _WORD.findall(token)}
            if not _READERS.isdisjoint(words):
                return "readers"
            if name != "article" and (hit := _NOISE & words):
                return "open" if hit <= _OPEN else "words"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
    return ""


def parse(html: str, by_words: bool = True, forms: bool = False) -> Node:
    """The tree of blocks below a body node; by_words: class words leave elements out; forms: what stands in forms is read."""
    body = node = Node("body", None)
    skip: list[str] = []  # open elements inside one that is left out
    reason, began, wanted, seen = "", 0, -1, False  # why and where that began; where one must stay; an article was seen
    links = 0
    token = _TOKEN
    at = 0
    size = len(html)
    while at < size:
        end = at
        while (end := html.find("<", end)) >= 0:
            if m := token.match(html, end):
                break
            if token is _TOKEN and re.match(r"[a-zA-Z/!?]", html[end + 1 : end + 2]):
                token = _LOOSE
            else:
                end += 1
        if end < 0:
            m, end = None, size
        if end > at and not skip:
            node.children.append((html[at:end], links > 0))
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        closing = m[1]
        if skip:
            if closing:
                if name in skip:
                    del skip[len(skip) - 1 - skip[::-1].index(name) :]
            elif name in _RAW:
                at = _raw_end(html, name, at)
            elif name in ("article", "main") and reason == "words" and not seen and not _noise(name, m[3], True):
                skip, at, wanted = [], began, began  # it holds the article: read it after all
            elif name not in _VOID:
                if name in _BLOCKS and skip[-1] == "p":
                    skip.pop()
                    if not skip:  # the tag stands outside again
                        at = m.start()
                        continue
                skip.append(name)
            continue
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCKS:
                up = node
                while up is not body and up.name != name:
                    up = up.parent
                if up is not body:
                    node, links = up.parent, 0
                elif name == "p":
                    node.children.append(Node("p", node))
            continue
        if name in _RAW:
            at = _raw_end(html, name, at)
            continue
        if name in ("html", "body"):
            continue
        if name in _NO_P:
            up = node
            while up is not body and up.name in ("p",):
                up = up.parent
            if up is not node:
                node, links = up, 0
            if name in _ENDS:
                up = node
                while up is not body and up.name not in _FENCE[name]:
                    if name in _ENDS.get(up.name, ()):
                        node = up.parent
                        break
                    up = up.parent
        inside = node.inside
        reason = _noise(name, m[3], inside, forms) if m.start() != wanted else ""
        doubt = (reason == "words" and inside or reason == "open") and name != "a"  # judged when all is counted
        reason = "words" if reason == "open" else reason
        if reason and not doubt and (by_words or reason != "words"):
            if name not in _VOID and not m[3].endswith("/"):
                skip.append(name)
                began = m.start()
            continue
        seen |= name in ("article", "main")
        if name in _BLOCKS and name not in _VOID:
            child = Node(name, node)
            child.doubt = doubt
            node.children.append(child)
            node = child
        elif name == "hr":
            node.children.append(Node("hr", node))
        else:
            node.tags += 1
            if name == "a":
                node.link_tags += 1
                links += 1
            elif name in ("br", "wbr"):
                node.children.append((" " if name == "br" else "", links > 0))
    return body


def _raw_end(html: str, name: str, at: int) -> int:
    """Where the text of a script and the like ends; the end of the page if it is never closed."""
    m = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
    if not m:
        return len(html)
    close = html.find(">", m.start())
    return close + 1 if close >= 0 else len(html)


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    return out


def _density(n: Node, ratio: float) -> float:
    c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - n.link_chars) * lc + ratio * c + math.e)
    return max(0.0, c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / max(1e-9, math.log(max(base, 1.0 + 1e-9) + 1e-9)))


def _settle(doubted: list[Node], body: Node) -> None:
    """Take out parts that a class word and their links or thin text (against the article, or the page) both mark; parents come first."""
    ratio = body.link_chars / max(1, body.chars)
    gone: set[int] = set()
    for n in doubted:
        up, top = n.parent, None
        while up is not None and id(up) not in gone:
            top = up if up.name in ("article", "main") else top
            up = up.parent
        top = top or body
        if up is not None or 2 * n.link_chars <= n.chars and 2 * _density(n, ratio) >= _density(top, ratio):
            continue
        gone.add(id(n))
        n.parent.children.remove(n)
        up = n.parent
        while up is not None:
            up.chars -= n.chars
            up.link_chars -= n.link_chars
            up.tags -= n.tags
            up.link_tags -= n.link_tags
            up = up.parent


def measure(body: Node) -> list[Node]:
    """Counts and densities of all nodes; the nodes in an order with parents first."""
    nodes = _order(body)
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.link_chars += c.link_chars
                n.tags += c.tags
                n.link_tags += c.link_tags
            else:
                k = len(_SPACE.sub("", c[0]))
                n.chars += k
                n.link_chars += k * c[1]
    if doubted := [n for n in nodes if n.doubt]:
        _settle(doubted, body)
        nodes = _order(body)
    ratio = body.link_chars / max(1, body.chars)
    for n in nodes:
        n.density = _density(n, ratio)
    # Sums of children's densities, upwards: each node knows the densest subtree at or below it.
    for n in reversed(nodes):
        kids = _children(n)
        n.most = sum(k.density for k in kids) if kids else n.density
        if kids and any(isinstance(c, tuple) and c[0].strip() for c in n.children):
            n.most += n.density
        for k in kids:  # the densest subtree below a node; ties: the first
            if k.most > n.most:
                n.best, n.most = k.best, k.most
    return nodes


def _children(n: Node) -> list[Node]:
    return [c for c in n.children if isinstance(c, Node)]


def content(body: Node) -> list[Node]:
    """The subtrees that hold the article."""
    best = body.best
    least, up = best.density, best
    while up is not None:
        least, up = min(least, up.density), up.parent
    found: dict[int, Node] = {}
    todo = [body]
    while todo:
        n = todo.pop()
        if n.density >= least and n.chars:
            top = n.best
            found[id(top)] = top
            todo += _children(n)
    marked = list(found.values())
    paths = []
    for n in marked:
        path = []
        while n is not None:
            path.append(n)
            n = n.parent
        paths.append(path[::-1])
    depth = 0
    while all(len(p) > depth and p[depth] is paths[0][depth] for p in paths):
        depth += 1
    top = paths[0][depth - 1]
    if top is not body:
        return [top]
    kept = set(map(id, marked))
    order = {id(n): i for i, n in enumerate(_document_order(body))}
    return sorted((n for n, p in zip(marked, paths, strict=True) if not any(id(x) in kept for x in p[:-1])), key=lambda n: order[id(n)]) if id(body) not in found else [body]


def _document_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += reversed(_children(n))
    return out


def blocks(root: Node) -> Iterator[str]:
    """Texts of the blocks in page order, without menus."""
    todo: list = [root]
    run: list = []
    linked: list[str] = []  # the last blocks, as far as they are mostly links
    place, before = root, ""  # where the run stands; the element of the last block that is not linked
    within = titled = False  # the linked ones began inside an article; there under a heading

    def menu() -> bool:
        return len(linked) >= 3 and not titled and not (within and sum(map(len, linked)) >= LABEL * len(linked))

    def flush() -> Iterator[str]:
        nonlocal before, within, titled
        text = _SPACE.sub(" ", unescape("".join(x for x, _ in run))).strip() if run else ""
        links = sum(len(x.strip()) for x, a in run if a)
        total = sum(len(x.strip()) for x, _ in run)
        run.clear()
        if text and 2 * links > total:
            if not linked:
                within = place.inside
                titled = within and before in _HEADINGS
            linked.append(text)
        elif text:
            if not menu():
                yield from linked
            linked.clear()
            yield text
            before = place.name

    while todo:
        c = todo.pop()
        if isinstance(c, tuple):
            run.append(c)
            continue
        yield from flush()
        if isinstance(c, Node):
            todo.append([c.parent or c])
            todo += reversed(c.children)
            place = c
        else:
            place = c[0]
    yield from flush()
    if not menu():
        yield from linked


def main_text(html: str | None) -> str:
    """The article of a page."""
    if not html:
        return ""
    for by_words, forms in ((True, False), (False, False), (False, True)):
        body = parse(html, by_words, forms)
        measure(body)
        if body.chars:
            break
    else:
        return ""
    return "\n".join(t for n in content(body) for t in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` with text and n_chars; columns with these names give way."""
    bounded_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    keep = [c for c in pages.columns if c != "html"]
    schema = extended(pages.drop("html").schema, "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
