"""Main text: pages made to be slow, parts of an article that must stay, and the ratios in a second form."""

import math
import random
import re
import time
from html.parser import HTMLParser

import pytest

from structscreen.llm import html_text

SLOW = ['"', "<a ", "<div>", "<b>", "<!--", "<", '<a ="', '<a =">" ', "<a =\"'<b ='", "<b><h1>", "<div class=ad>x", "<p hidden>x", "<li>x", "<b></i>", "<li><dt>", "<table><td>", "<a><b>x", "&", "<script>", "<span class=ad>x", "<article><header><p>x"]


@pytest.mark.parametrize("unit", SLOW)
def test_time_grows_with_the_page(unit):
    for before in ("", "<p>hello</p><a "):
        began = time.process_time()
        html_text.main_text(before + unit * ((1 << 20) // len(unit)))
        assert time.process_time() - began < 8  # a second or so on an idle machine; what grows with the square takes minutes


def test_a_tag_that_never_closes_is_text():
    said = 'He wrote: if x <y then he said "yes" and "no". ' * 30
    assert html_text.main_text(f"<p>{said}</p>") == said.strip()
    assert html_text.main_text("<p>hello</p><a " + '"' * 40) == "hello\n\n<a " + '"' * 40


LONG = "<p>A long paragraph of the article, with words; and more of them.</p>"
STAYS = {
    f"<article>{LONG}<p>Let <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math> be so.</p></article>": "Let x = 1 be so.",
    f"<article>{LONG}<p>One <object data=x>two</object> three.</p></article>": "One two three.",
    f"<article>{LONG}<p>One <svg><text>drawn</text></svg>two <canvas>none</canvas>three.</p></article>": "One two three.",
    f"<article>{LONG}<ol><li><a href=x>First reference, 1999</a><li><a href=y>Second reference, 2001</a></ol></article>": "First reference, 1999\n\nSecond reference, 2001",
    f"<article><header><h1>Title</h1><p>The lead paragraph.</p></header>{LONG}</article>": "Title\n\nThe lead paragraph.",
    f"<article>{LONG}<div><p>Short.</p></div>{LONG}</article>": "Short.",
    f"<div>{LONG}<blockquote>Short.</blockquote>{LONG}</div>": "Short.",
}


@pytest.mark.parametrize("page", STAYS)
def test_text_of_the_article_stays(page):
    whole = re.sub("<.*?>", "", LONG)
    text = html_text.main_text(page)
    assert STAYS[page] in text and text.count(whole) == page.count(LONG)
    assert text.replace(whole, "").strip() == STAYS[page]


class _Plain(HTMLParser):
    """Blocks of well-formed pages without marks: (path of block tags, text, link characters)."""

    def __init__(self):
        super().__init__()
        self.open, self.found, self.text, self.linked = [], [], "", ""

    def cut(self):
        whole, links = " ".join(self.text.split()), " ".join(self.linked.split())
        if whole:
            self.found.append(("/".join(t for t in self.open if t != "a"), whole, len(links)))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.cut()
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag != "a":
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        self.text += data
        self.linked += data if "a" in self.open else ""


def plain_main_text(page):
    reader = _Plain()
    reader.feed(page)
    nodes = reader.found
    stats = {}
    for path, text, links in nodes:
        n, chars, marks, linked = stats.get(path, (0, 0, 0, 0))
        stats[path] = (n + 1, chars + len(text), marks + sum(text.count(c) for c in ".,;:!?"), linked + links)
    by = [(stats[p][1] / stats[p][0], stats[p][2] / stats[p][0], stats[p][3] / stats[p][1]) for p, _, _ in nodes]

    def smooth(k, at):
        near = [(i, math.exp(-0.5 * (i - at) ** 2)) for i in range(max(0, at - 2), min(len(by), at + 3))]
        return sum(by[i][k] * w for i, w in near) / sum(w for _, w in near)

    fused = [math.sqrt(by[i][0] * smooth(0, i)) * (1 + smooth(1, i)) * (1 - by[i][2]) for i in range(len(nodes))]
    score = {}
    for (path, _, _), f in zip(nodes, fused):
        score.setdefault(path, []).append(f)
    least = 0.25 * sum(f * len(t) for f, (_, t, _) in zip(fused, nodes)) / sum(len(t) for _, t, _ in nodes)
    good = [sum(score[p]) / len(score[p]) >= least and by[i][2] <= 0.6 for i, (p, _, _) in enumerate(nodes)]
    picked = [i for i, g in enumerate(good) if g]
    for i in range(len(nodes)):
        before, after = [k for k in picked if k < i], [k for k in picked if k > i]
        parent = lambda k: nodes[k][0].rpartition("/")[0]
        if not good[i] and before and after and parent(before[-1]) == parent(after[0]) == parent(i) and by[i][2] <= 0.6:
            good[i] = True
    for i in range(len(nodes) - 2, -1, -1):
        good[i] = good[i] or good[i + 1] and nodes[i][0].rpartition("/")[2] in ("h1", "h2")
    return "\n\n".join(t for (_, t, _), g in zip(nodes, good) if g)


def test_ratios_against_a_second_form():
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["word", "other", "more, and", "end.", "x"]) for _ in range(n))

    def part(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            tag = rng.choice(["div", "section", "ul"])
            return f"<{tag}>{''.join(part(depth - 1) for _ in range(rng.randrange(1, 5)))}</{tag}>"
        if kind < 0.6:
            return f"<p>{words(rng.randrange(1, 60))}</p>"
        if kind < 0.7:
            return f"<h2>{words(3)}</h2>"
        if kind < 0.85:
            return f"<li><a>{words(rng.randrange(1, 6))}</a> {words(rng.randrange(0, 3))}</li>"
        return f"<p>{words(4)} <a>{words(3)}</a> {words(5)}</p>"

    for _ in range(300):
        page = "".join(part(3) for _ in range(rng.randrange(1, 6)))
        assert html_text.main_text(page) == plain_main_text(page), page
