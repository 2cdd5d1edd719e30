"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each under the path of elements from the root.  Per path the text length and the number
of punctuation marks are summed and divided by the number of nodes: running text has long, punctuated nodes; menus and
labels have short ones.  Both ratios are smoothed over neighbouring nodes, fused by their product and compared with a
threshold from the page's own spread; paths above it are content.  The content element is the deepest one that holds
nearly all content text, widened to an enclosing article or main and upwards over blocks that are not mostly links; its blocks are the result, headings and short paragraphs included, but without subtrees that
are marked as something else by class, id or role (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
and without paths that are mostly links.  Marks on html, body, main and the article itself do not count, nor words behind has-, no- or
with-; a mark on an element that holds most of the page's content text is overruled.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one line feed.
Null and empty html give an empty text.  Cut-off pages are read to their end.  Rows are independent; nothing is
dropped, and repeated rows give equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|xmp|noembed|noframes)(?=[\s/>])(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
_BREAKS = frozenset(("br", "hr"))
_LEFT_OUT = frozenset("head nav footer aside form button select option input menu svg math object canvas audio video dialog script style noscript template iframe".split())
#: Marks in class, id or role of an element whose subtree is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar footer masthead"
    " comment comments commentlist reply replies respond disqus share sharing social related recommended widget login signup search pagination pager"
    " contentinfo complementary toolbar skip".split()
)
#: Marks of texts of their own, which can be longer than the article: only overruled if next to nothing is left without them.
_OWN_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices"
    " popup modal newsletter comment comments commentlist reply replies respond disqus".split()
)
_WITHOUT = frozenset(("has", "no", "with", "without"))
_HEADER_MARKS = frozenset(("header", "siteheader", "pageheader"))
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CLOSED_BY = {  # an opening tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
_SCOPE = frozenset("table ul ol dl article section div body html td th select".split())
_HEADING = re.compile(r"(?:^|/)h[1-6](?:/|$)")
PUNCTUATION = re.compile(r"[,.;:!?…。，、；：！？¿¡\"'()«»“”„‘’]")


def _words(value: str) -> set[str]:
    """Words of a class, id or role; those behind has-, no- or with- say nothing about the element itself."""
    words: set[str] = set()
    for name in value.split():
        for w in _SPLIT.split(name):
            if w.lower() in _WITHOUT:
                break
            words.add(w.lower())
    return words


def _marked(tag: str, attrs: str, in_article: bool, in_own: bool) -> str:
    """"out" if the subtree is left out for certain; "own" or "frame" if its words say that it is not the article; or ""."""
    if tag in _LEFT_OUT or tag == "header" and not in_article:
        return "out"
    if not attrs or attrs == "/" or tag in ("html", "body"):
        return ""
    found = ""
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and (a or b or c) == "true":
            return "out"
        if name in ("class", "id", "role"):
            if tag == "main" or tag == "article" and not in_own:  # an article in an article can be a reader's comment
                continue
            words = _words(a or b or c)
            if words & _OWN_TEXT:
                found = "own"
            elif words & _MARKS or not in_article and words & _HEADER_MARKS:
                found = found or "frame"
        elif name == "style" and re.search(r"display\s*:\s*none", a or b or c, re.I):
            return "out"
    return found


class _Page:
    """Text nodes of a page in order: (element numbers from the root, tag path, block, text, in a link)."""

    def __init__(self, html: str) -> None:
        self.nodes: list[tuple[tuple[int, ...], str, int, str, bool]] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, left out
        self.articles: set[int] = set()  # numbers of article and main elements
        self.marks: dict[int, str] = {}  # kind of mark by element number
        self.block = self.count = 0
        self.links = 0
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag:
                (self.close if m["close"] else self.open)(tag.lower(), m["attrs"])
        self.text(html[at:])

    def text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1][2]):
            text = unescape(raw)
            path = "/".join(t for t, _, _ in self.stack)
            self.nodes.append((tuple(n for t, n, _ in self.stack if t not in _INLINE or n in self.marks), path, self.block, text, self.links > 0))

    def pop(self, to: int) -> None:
        for tag, _, _ in self.stack[to:]:
            self.links -= tag == "a"
            self.block += tag not in _INLINE
        del self.stack[to:]

    def open(self, tag: str, attrs: str) -> None:
        if tag in _BREAKS:
            self.block += 1
        if tag in _VOID:
            return
        ends = _CLOSED_BY.get(tag, frozenset())
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k][0]
            if t in ends or t == "p" and tag not in _INLINE:
                self.pop(k)
                break
            if t in _SCOPE:
                break
        if tag not in _INLINE:
            self.block += 1
        if attrs.endswith("/") and tag not in _INLINE and tag in ("path", "use", "circle"):
            return
        above = {t for t, _, _ in self.stack}
        mark = _marked(tag, attrs, bool(above & {"article", "main"}), "article" in above)
        out = bool(self.stack and self.stack[-1][2]) or mark == "out"
        self.count += 1
        if mark and not out:
            self.marks[self.count] = mark
        if tag in ("article", "main"):
            self.articles.add(self.count)
        self.links += tag == "a"
        self.stack.append((tag, self.count, out))

    def close(self, tag: str, _: str) -> None:
        if tag in _BREAKS or tag == "p" and not any(t == "p" for t, _, _ in self.stack):
            self.block += 1
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop(k)
                return
            if tag in _INLINE and self.stack[k][0] not in _INLINE:
                return


def _smooth(values: list[float]) -> list[float]:
    """Weighted mean over the node and its two neighbours on either side."""
    n, weights = len(values), (0.054, 0.242, 0.399, 0.242, 0.054)  # normal density at -2 ... 2
    out = []
    for i in range(n):
        got = [(w, values[i + k - 2]) for k, w in enumerate(weights) if 0 <= i + k - 2 < n]
        out.append(sum(w * v for w, v in got) / sum(w for w, _ in got))
    return out


def content_nodes(nodes: list) -> list[bool]:
    """Which nodes lie on content paths: fused, smoothed ratios against the page's threshold."""
    paths: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        paths.setdefault(n[1], []).append(i)
    length, marks = [0.0] * len(nodes), [0.0] * len(nodes)
    for at in paths.values():
        size = sum(len(nodes[i][3]) for i in at) / len(at)
        punct = sum(len(PUNCTUATION.findall(nodes[i][3])) for i in at) / len(at)
        for i in at:
            length[i], marks[i] = size, punct
    fused = [a * (1 + b) for a, b in zip(_smooth(length), _smooth(marks), strict=True)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    limit = min(spread, mean)  # even pages have no spread: all of it is content
    chosen = {nodes[i][1] for i, x in enumerate(fused) if x >= limit}
    return [n[1] in chosen for n in nodes]


def _unmarked(page: _Page) -> list:
    """The page's nodes outside marked elements.  A mark is overruled if its element holds most of the text on content paths
    (a text of its own, such as a notice or comments: only if the unmarked text is less than a tenth of it)."""
    if not page.marks:
        return page.nodes
    texts = [n for n in page.nodes if n[3].strip()]
    if not texts:
        return []
    size = [len(n[3]) if c and not n[4] else 0 for n, c in zip(texts, content_nodes(texts), strict=True)]
    total, marks = sum(size), dict(page.marks)
    for e, kind in page.marks.items():  # outer elements first
        mine = sum(s for n, s in zip(texts, size, strict=True) if e in n[0])
        if mine <= 0.5 * total:
            continue
        left = sum(len(n[3].strip()) for n in texts if not n[4] and not any(x in marks for x in n[0]))
        if kind == "frame" or left < 0.1 * mine:
            del marks[e]
    return [n for n in page.nodes if not any(x in marks for x in n[0])]


def _widened(nodes: list, content: list[bool], holder: int, whole: set[int]) -> tuple[int | None, set[int]]:
    """The element that the text is taken from, upwards from the holder, and the link-heavy elements left out on the way.

    An enclosing article or main (``whole``) is always taken; above it and without one, an element that adds link-heavy blocks is
    taken only if it adds a heading besides them."""
    chain = next(n[0] for n in nodes if holder in n[0])
    k = chain.index(holder)
    dropped: set[int] = set()
    must = max((i for i in range(k + 1) if chain[i] in whole), default=None)
    if must is not None:
        k = must
    while k >= 0:  # to the parent, and at last to text outside all elements
        parent = chain[k - 1] if k else None
        added = [(n, c) for n, c in zip(nodes, content, strict=True) if (parent is None or parent in n[0]) and chain[k] not in n[0]]
        groups: dict[int, list] = {}
        for n, c in added:
            groups.setdefault(n[0][k] if len(n[0]) > k else -1, []).append((n, c))
        heavy = set()
        for e, got in groups.items():
            linked = sum(len(n[3].strip()) for n, _ in got if n[4])
            if e >= 0 and linked > 0.5 * sum(len(n[3].strip()) for n, _ in got) and not any(c and not n[4] for n, c in got):
                heavy.add(e)
        heading = any(_HEADING.search(n[1]) for n, _ in added if not any(e in heavy for e in n[0]))
        if heavy and not heading:
            break
        dropped |= heavy
        k -= 1
    return (chain[k] if k >= 0 else None), dropped


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page(html)
    page.nodes = _unmarked(page)
    nodes = [n for n in page.nodes if n[3].strip()]
    if not nodes:
        return ""
    content = content_nodes(nodes)
    weight: dict[int, int] = {}
    total = 0
    for n, c in zip(nodes, content, strict=True):
        if c and not n[4]:
            total += len(n[3])
            for e in n[0]:
                weight[e] = weight.get(e, 0) + len(n[3])
    # deepest element with nearly all of the content; elements are numbered in page order, so deeper means larger on one path
    holder = max((e for e, w in weight.items() if w >= 0.9 * total), default=None) if total else None
    dropped: set[int] = set()
    if holder is not None:  # the rest of the article stands beside it: headings, introductions, short sections
        holder, dropped = _widened(nodes, content, holder, page.articles)
    inside = [(holder is None or holder in n[0]) and not any(e in dropped for e in n[0]) for n in nodes]
    links: dict[str, list[int]] = {}
    for n in nodes:
        whole = links.setdefault(n[1].partition("/a")[0] if n[4] else n[1], [0, 0])
        whole[0] += len(n[3].strip())
        whole[1] += len(n[3].strip()) if n[4] else 0
    blocks: dict[int, list[str]] = {}
    keep = {}
    for n, c, i in zip(nodes, content, inside, strict=True):
        of = links[n[1].partition("/a")[0] if n[4] else n[1]]
        keep[id(n)] = i and (c or of[1] <= 0.5 * of[0])
    for n in page.nodes:
        if keep.get(id(n), not n[3].strip()):
            blocks.setdefault(n[2], []).append(n[3])
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str, text: str = "text") -> DataFrame:
    """``pages`` without the html column, plus its main text (a column of that name is replaced)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(main_text, na_action=None)

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (html, text)]
    return pages.select(*kept, run(F.col(f"`{html}`")).alias(text))
