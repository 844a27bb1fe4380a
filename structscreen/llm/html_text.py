"""Main text of web pages by tag-path ratios.

A page is cut into blocks (runs of text between block-level tags); the root-to-leaf path of block
tags is the block's tag path.  Per path the text length and the punctuation of its blocks are
summed and divided by their number; both ratios are smoothed along the page with a Gaussian and
fused (geometric mean of plain and smoothed text ratio, times one plus the smoothed punctuation
ratio, times the share of text outside links).  A path whose mean fused value reaches ``SHARE`` of the page's length-weighted mean is content, and
content paths select their blocks.

Parts that are never the article leave before the ratios are taken: navigation, page headers and
footers, asides, forms, scripts, styles and hidden elements.  Elements whose class, id or role says
menu, advert, notice, comments and the like (whole names, or names joined from such words alone)
are paths of their own that weigh ``APART`` in the score.  Neither holds for a hidden or marked
element around the article, nor a mark for one around most of the page's text (``_lifted``).

If a page marks its article (``article``, ``main``, role main), paths inside it weigh up to
``INSIDE`` times as much and have a lower threshold, both by the share of the page's unlinked
text that the article holds: from half on every path inside is content, however short and even
if it is mostly links, and cards beside an unmarked main text are judged as any other path.  Paths
outside are content by their score, and so are short ones between content of the same parent.  A heading right before
selected blocks belongs to them.

Markup is read forward only: quoted strings count after ``=``, and a ``<`` whose tag does not close before the next ``<`` is
text.  Paths, marks and open elements are numbers and counters, so time and memory grow with the page, whatever its depth.

Defined cases: null or empty html gives empty text; text outside any tag is a block of the root
path; unclosed elements end where their parent ends or a sibling must begin; an unclosed comment,
script or style runs to the end of the page; formulas and the words of ``object`` belong to their line; equal rows give equal
results; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SHARE = 0.25
APART = 0.05  # weight of paths in elements that a class, id or role sets apart
INSIDE = 4.0  # weight of paths inside the marked article, to the power of its share of the text
LINKED = 0.6  # a path with a larger share of link text is a list of links
_KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture "
    "object math svg canvas audio video select button datalist".split()
)
_DROPPED = frozenset("nav footer aside form head script style select button svg canvas audio video dialog menu noscript template iframe textarea title option datalist annotation annotation-xml".split())
_ARTICLE = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSED_BY = {  # an open element that ends when one of these begins
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "head": frozenset(("body",)), "option": frozenset(("option", "optgroup")),
}
_SCOPES = frozenset(("ul", "ol", "dl", "table", "body", "html", "article", "section", "main", "div"))
_MARKS = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "sidebar", "menu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion",
    "related", "recommended", "recommendations", "share", "sharing", "social", "widget", "widgets", "search", "searchbox", "pagination", "pager", "copyright", "disclaimer", "skip", "hidden",
))
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"))
_IN_LINE = 2
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_INSIDE_TAG = re.compile(r"""(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+""")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
_PARTS = re.compile(r"[-_]+")
_BESIDE = frozenset("site list box slot unit links bar".split())  # parts that say nothing beside a mark


def _attributes(text: str) -> dict[str, str]:
    """Values of an element's attributes by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(value.strip("\"'")).lower())
    return found


def _is_mark(token: str) -> bool:
    """Is a whole class or id name a mark, or joined from marks alone (``cookie-notice``, ``comment-list``)?"""
    parts = [x for x in _PARTS.split(token) if x]
    return not _MARKS.isdisjoint(parts) and all(x in _MARKS or x in _BESIDE for x in parts)


def _said_apart(given: dict[str, str], tag: str, article: bool) -> str:
    """Do the attributes say that the element is not part of the article? ``hidden``, ``mark`` or nothing."""
    if "hidden" in given or given.get("aria-hidden") == "true" or _HIDING.search(given.get("style", "")):
        return "hidden"
    names = () if tag in _HEADINGS else (*given.get("class", "").split(), *given.get("id", "").split())
    if given.get("role") in _ROLES or any(_is_mark(x) and not (article and x == "header") for x in names):
        return "mark"
    return ""


def _tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(begin, end, name, attributes, closes) of the markup in page order; comments and raw elements have no name."""
    at = 0
    while (begin := html.find("<", at)) >= 0:
        at = begin + 1
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4) + 3 or 0
            at = end if end > 2 else len(html)
            yield begin, at, "", "", False
        elif html.startswith("<![CDATA[", begin):
            end = html.find("]]>", begin) + 3
            at = end if end > 2 else len(html)
            yield begin, at, "", "", False
        elif html[at:at + 1] in ("!", "?") or html[at:at + 1] == "/" and not html[at + 1:at + 2].isalpha():
            end = _INSIDE_TAG.match(html, at).end()
            if html[end:end + 1] == ">":
                at = end + 1
                yield begin, at, "", "", False
        else:
            closes = html[at:at + 1] == "/"
            name = _NAME.match(html, at + closes)
            if not name:
                continue
            end = _INSIDE_TAG.match(html, name.end()).end()
            if html[end:end + 1] != ">":
                continue
            tag, given = name[0].lower(), html[name.end():end]
            at = end + 1
            if tag in _ENDS and not closes:
                over = _ENDS[tag].search(html, at)
                at = over.end() if over else len(html)
                yield begin, at, "", "", False
            else:
                yield begin, at, tag, given, closes


class _Page:
    """What one pass over a page finds.

    ``blocks`` holds (path, text, inside the marked article, characters in links, mark); paths and marks are numbers whose parents
    are known.  Path 0 is the root, mark 0 stands for no marked element around.
    """

    def __init__(self):
        self.blocks: list[tuple[int, str, bool, int, int]] = []
        self.paths: dict[tuple[int, str], int] = {(-1, ""): 0}
        self.marks: list[tuple[int, int, bool]] = [(-1, -1, False)]  # parent, place in the page, hidden
        self.marked_inline = False


class _Open:
    """The open elements, with counts by name and the way from each to the next one that a sibling may end or that ends the search."""

    def __init__(self):
        # tag, path, is dropped (``_IN_LINE``: as a part of a line), is in the article, mark, place of the next entry that matters to a new block
        self.stack: list[tuple[str, int, bool, bool, int, int]] = [("", 0, False, False, 0, 0)]
        self.count: dict[str, int] = {}
        self.headings = 0

    def push(self, tag: str, path: int, dropped: bool, article: bool, mark: int) -> None:
        place = len(self.stack)
        matters = tag == "p" or tag in _CLOSED_BY or tag in _SCOPES
        self.stack.append((tag, path, dropped, article, mark, place if matters else self.stack[-1][5]))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.headings += tag in _HEADINGS

    def last(self, tag: str) -> int:
        """Place of the last open element of this name, 0 if there is none."""
        if not self.count.get(tag):
            return 0
        place = len(self.stack) - 1
        while self.stack[place][0] != tag:
            place -= 1
        return place

    def ended_by(self, tag: str) -> int:
        """Place of the element that ends where a block ``tag`` begins, 0 if none does."""
        place = self.stack[-1][5]
        while place:
            name = self.stack[place][0]
            if name == "p" or tag in _CLOSED_BY.get(name, ()):
                return place
            if name in _SCOPES:
                return 0
            place = self.stack[place - 1][5]
        return 0

    def pop_to(self, place: int) -> bool:
        """Close all from ``place`` on; was a block or a marked element among them?"""
        gone = self.stack[place:]
        cuts = gone[-1][4] != self.stack[place - 1][4] or gone[-1][1] != self.stack[place - 1][1]
        del self.stack[place:]
        for tag, *_ in gone:
            self.count[tag] -= 1
            self.headings -= tag in _HEADINGS
        return cuts


def _parsed(html: str, lifted: set[int] | None) -> _Page:
    """Blocks and marks of a page; with ``lifted``, words in marked inline elements leave their line without a cut."""
    page, is_open = _Page(), _Open()
    text: list[str] = []
    linked: list[str] = []

    def flush(top: tuple) -> None:
        whole = " ".join(unescape("".join(text)).split())
        if whole:
            inside = len(" ".join(unescape("".join(linked)).split())) if linked else 0
            page.blocks.append((top[1], whole, top[3], inside, top[4]))
        text.clear()
        linked.clear()

    def put(piece: str) -> None:
        if piece and not is_open.stack[-1][2]:
            text.append(piece)
            if is_open.count.get("a"):
                linked.append(piece)

    def pop_to(place: int) -> None:
        top = is_open.stack[-1]
        if is_open.pop_to(place):
            flush(top)

    at = 0
    for begin, end, tag, attributes, closes in _tags(html):
        put(html[at:begin])
        at = end
        if not tag:
            continue
        if closes:
            if place := is_open.last(tag):
                pop_to(place)
            continue
        if tag == "br":
            put(" ")
            continue
        # nothing within a formula or a dropped part of a line cuts it
        within = is_open.stack[-1][2] == _IN_LINE or bool(is_open.count.get("math"))
        inline = within or tag in _INLINE
        if not inline:
            if place := is_open.ended_by(tag):
                pop_to(place)
            flush(is_open.stack[-1])
        if tag in _VOID or attributes.endswith("/"):
            continue
        _, path, dropped, article, mark, _ = is_open.stack[-1]
        given = _attributes(attributes) if attributes.strip() else {}
        is_article = tag in _ARTICLE or given.get("role") == "main"
        said = ""
        if not dropped:
            if tag == "header":
                dropped = not article
            elif tag in _DROPPED:
                dropped = _IN_LINE if inline else True
            elif tag not in ("html", "body") and tag not in _ARTICLE and given and (said := _said_apart(given, tag, article)):
                if inline and lifted is not None:
                    dropped = begin not in lifted
                else:
                    if inline:
                        page.marked_inline = True
                        flush(is_open.stack[-1])
                    page.marks.append((mark, begin, said == "hidden"))
                    mark = len(page.marks) - 1
            if article and tag in ("time", "address") and is_open.count.get("header") and not is_open.headings:
                dropped = True  # date and names of the article's own header
        if not inline:
            name = f"{tag}{'@' if is_article and tag not in _ARTICLE else ''}{said and '!'}"
            path = page.paths.setdefault((path, name), len(page.paths))
        if tag == "a" and (place := is_open.last("a")):
            pop_to(place)
        is_open.push(tag, path, dropped, article or is_article, mark)
    put(html[at:])
    flush(is_open.stack[-1])
    return page


def _lifted(page: _Page) -> set[int]:
    """Places of marked elements that hold the article: their marks do not count.

    A mark is lifted from an element if no article worth a tenth of its text lies outside all marks, and it holds most
    of the text of articles and more than lies outside all marks, or (if it is not hidden) most of the page's text.
    """
    length, own = np.zeros(len(page.marks)), np.zeros(len(page.marks))
    for _, text, article, _, mark in page.blocks:
        length[mark] += len(text)
        own[mark] += len(text) if article else 0
    held, article = length.copy(), own.copy()
    for mark in range(len(page.marks) - 1, 0, -1):  # parents come before their children
        held[page.marks[mark][0]] += held[mark]
        article[page.marks[mark][0]] += article[mark]
    free, free_own = float(length[0]), float(own[0])
    clear = np.zeros(len(page.marks), dtype=bool)
    clear[0] = True
    lifted: set[int] = set()
    for mark, (parent, place, hidden) in enumerate(page.marks):
        if not mark:
            continue
        most = 2 * held[mark] > held[0] and not hidden
        if (most or 2 * article[mark] > article[0]) and 10 * free_own < held[mark] and (most or held[mark] > free):
            lifted.add(place)
            if clear[parent]:
                clear[mark] = True
                free += float(length[mark])
                free_own += float(own[mark])
    return lifted


def blocks(html: str) -> tuple[list[tuple[int, str, bool, int, bool]], list[tuple[int, str]]]:
    """Blocks that can be content, and (parent, name) of every tag path.

    A block is (tag path, text, inside the marked article, characters of it in links, said to be apart).
    """
    page = _parsed(html, None)
    lifted = _lifted(page) if len(page.marks) > 1 else set()
    if page.marked_inline:
        page = _parsed(html, lifted)
    apart, unseen = [False], [False]
    for parent, place, hidden in page.marks[1:]:
        kept = place in lifted
        apart.append(apart[parent] or not kept)
        unseen.append(unseen[parent] or hidden and not kept)
    return [(*b[:4], apart[b[4]]) for b in page.blocks if not unseen[b[4]]], list(page.paths)


def main_text(html: str | None) -> str:
    """Selected blocks in page order, joined by two line breaks."""
    nodes, paths = blocks(html) if html else ([], [])
    if not nodes:
        return ""
    numbers = {path: k for k, path in enumerate(dict.fromkeys(n[0] for n in nodes))}
    of = np.array([numbers[n[0]] for n in nodes])
    length = np.array([len(n[1]) for n in nodes], dtype=np.float64)
    marks = np.array([len(_PUNCTUATION.findall(n[1])) for n in nodes], dtype=np.float64)
    links = np.array([n[3] for n in nodes], dtype=np.float64)
    number = np.bincount(of)
    text_ratio, mark_ratio = np.bincount(of, length) / number, np.bincount(of, marks) / number
    link_share = np.bincount(of, links) / np.maximum(1, np.bincount(of, length))

    def smooth(values: np.ndarray) -> np.ndarray:
        weight = np.convolve(np.ones(len(values)), _KERNEL)[2:-2]
        return np.convolve(values, _KERNEL)[2:-2] / weight

    apart = np.array([n[4] for n in nodes])
    fused = np.sqrt(text_ratio[of] * smooth(text_ratio[of])) * (1 + smooth(mark_ratio[of])) * (1 - link_share[of]) * np.where(apart, APART, 1.0)
    unlinked = np.where(apart, 0.0, length * (1 - link_share[of]))
    inside = np.array([n[2] for n in nodes]) & ~apart
    trust = np.where(inside, (unlinked * inside).sum() / max(1.0, unlinked.sum()), 0.0)
    fused *= INSIDE ** trust
    score = np.bincount(of, fused) / number
    threshold = SHARE * float((fused * length).sum() / length.sum())
    listed = (link_share[of] > LINKED) & (trust < 0.5)
    chosen = (score[of] >= threshold * np.maximum(0.0, 1 - 2 * trust)) & ~listed
    parents = np.array([paths[n[0]][0] for n in nodes])
    picked = np.flatnonzero(chosen)
    if len(picked):  # what stands between content of one parent
        before = picked[np.maximum(np.searchsorted(picked, np.arange(len(nodes)), side="right") - 1, 0)]
        after = picked[np.minimum(np.searchsorted(picked, np.arange(len(nodes))), len(picked) - 1)]
        between = (before < np.arange(len(nodes))) & (after > np.arange(len(nodes))) & (parents[before] == parents) & (parents[after] == parents)
        chosen |= between & ~listed & ~apart
    for k in range(len(nodes) - 2, -1, -1):
        if chosen[k + 1] and not apart[k] and paths[nodes[k][0]][1] in _HEADINGS:
            chosen[k] = True
    return "\n\n".join(n[1] for n, c in zip(nodes, chosen.tolist()) if c)


@F.pandas_udf(StringType())
def _main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([main_text(h) for h in batch], dtype=object)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` without ``html_col``, with ``text`` and ``n_chars`` (code points); columns of these names are replaced."""
    kept = [c for c in df.columns if c not in (html_col, "text", "n_chars")]
    found = df.select(*[F.col(c) for c in kept], _main_text(F.col(html_col).cast("string")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
