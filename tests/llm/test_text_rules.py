"""Quality rules, URL filters, HTML extraction, mixing."""

import re
from collections import Counter

import numpy as np
import pytest

from structscreen.llm import html_text, mixing, quality, urls


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "a", "a b", "a b c a b c", "x x x x x", "the of and to in a is that for it " * 9, "line\nline\n\nline \n other\x85word",
    "#*$ %&|<> é日本", " ".join(f"w{i % 17}" for i in range(400)), " ".join(f"u{i}" for i in range(3000)), "a b c d a b c", "a\x0bb\x0cc\rd",
]


def test_quality_counts_match_brute_force(docs):
    rows = quality.judge(docs(list(enumerate(TEXTS))).repartition(3)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]]
        want = brute_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
        assert r["fp"] == "mine"


def test_quality_rules_keep_prose_and_drop_junk(docs):
    prose = " ".join(f"the word{i} of text{i} and" for i in range(20)) + ".\nMore of it."
    rows = [(1, prose), (2, " ".join(f"w{i}*** the" for i in range(100))), (3, " ".join(f"W{i}!! THE" for i in range(100))), (4, " ".join(f"k{i} |" for i in range(90))), (5, prose)]
    kept = {r["doc_id"] for r in quality.keep_good(docs(rows)).collect()}
    assert kept == {1, 5}
    assert quality.keep_good(docs(rows)).columns == docs(rows).columns
    assert quality.judge(docs([])).count() == 0


RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def brute_rule(host, path, rules):
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


@pytest.mark.parametrize("rules", [RULES, (("a.b", "/x", "block"), ("b", "/xy/z", "allow"), ("b", "/xy/", "block"), ("b", "/xy/", "allow"), ("a.b", "", "allow"))])
def test_longest_rule_wins(spark, rules):
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "notexample.com", "b", "a.b", "c.a.b", "x.net", "net", "", "com.", "com:80"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/es/1", "/fr/", "/x", "/xy", "/xy/z", "/xy/", "//", "/xy/zz?q=/en/", "/en/#/fr/"]
    made = [f"http{s}://{h}{p}" for s in ("", "s") for h in hosts for p in paths] + [None, "", "no scheme/en/", "://b/x", "a\nb://b/x", "http://b/x://net/es/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(made)], "page_id long, url string, verdict string")
    rows = urls.judge_urls(df, rules).collect()
    assert len(rows) == len(made)
    for r in rows:
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        want = brute_rule(host, path, rules)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want and want[0], want[1] if want else "allow"), url


def test_url_rules_are_checked(spark):
    with pytest.raises(ValueError):
        urls.build_trie([("a", "/", "maybe")])
    with pytest.raises(ValueError):
        urls.build_trie([("a", "/", "allow")] * (urls.MAX_RULES + 1))
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty, RULES).count() == 0


PAGES = {
    "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy now.</div><article><h1>Head &amp; tail</h1>"
    "<p><b>One &nbsp; two.<br><p>Three\n four.</p></article><footer>&copy; me</footer></body></html>": "Head & tail\n\nOne two.\n\nThree four.",
    "<div id=comments>first!</div><main><p>Text here.</p><aside>Related</aside><form><p>Name</p></form></main>": "Text here.",
    "<article><p>a</p><script>var x='</p>';</script><style>p{}</style><p>b</p><div class=\"cookie-notice\">ok?</div></article>": "a\n\nb",
    "plain text &lt;only&gt;": "plain text <only>",
    "<p>cut <!-- never closed": "cut",
    "": "",
    "<article>": "",
    "<article><ul><li>x<li>y</ul><table><tr><td>c<td>d</table></article>": "x\n\ny\n\nc\n\nd",
    "<nav>only menu</nav>": "",
    "a < b and <p>c": "a < b and\n\nc",
}


def test_main_text_of_pages(spark):
    rows = [(i, "u", h, 3) for i, h in enumerate(PAGES)] + [(99, None, None, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    want = {i: (t, len(t)) for i, t in enumerate(PAGES.values())} | {99: ("", 0)}
    assert got == want


def test_unmarked_page_by_ratios():
    body = "".join(f"<p>Sentence number {i}, with some words in it. And another one, too; yes.</p>" for i in range(6))
    page = f"<div><ul>{''.join(f'<li><a href=x>link {i}</a></li>' for i in range(9))}</ul></div><div><h2>Title</h2>{body}</div><div><span>tiny</span></div>"
    text = html_text.main_text(page)
    assert text.startswith("Title\n\nSentence number 0") and "link" not in text and "tiny" not in text
    assert len(html_text.main_text("<p>" + "long text. " * 100_000 + "</p>")) > 1_000_000


ARTICLE = "<article><h1 class='article-header'>The title</h1><p>First sentence of it, with words.</p><p>Second one.</p></article>"


@pytest.mark.parametrize("around", [
    "<div class='overflow-hidden'>{}</div>", "<div class='layout has-sidebar'>{}</div>", "<div class='page no-sidebar'>{}</div>", "<div title='a hidden gem'>{}</div>",
    "<div data-hidden='false'>{}</div>", "<div data-id='menu-1'>{}</div>", "<div class='overlay'><ol class='comment-list'><li>Nice one, that. And long, too, yes.</ol>{}</div>",
    "<span id=search>{}</span>", "<div hidden>{}</div>", "<div class=sidebar><p>Other words here, a few.</p></div><div id=modal>{}</div>", "{}<div hidden><p>Unseen words, hidden away.</p></div>",
])
def test_marks_do_not_drop_the_article(around):
    assert html_text.main_text(around.format(ARTICLE)) == "The title\n\nFirst sentence of it, with words.\n\nSecond one."


def test_marks_weigh_in_the_score():
    assert html_text.main_text("<div class=widget><p>Most of the text, in a marked part; yes.</p></div><p>x</p>") == "Most of the text, in a marked part; yes."
    assert html_text.main_text("<p>one <span class=ad>buy</span> two</p>") == "one two"


def test_cards_beside_an_unmarked_main_text():
    said = [f"Sentence number {i} of the main text, with some more words in it. And another one, too; yes." for i in range(6)]
    main, whole = "".join(f"<p>{x}</p>" for x in said), "\n\n".join(["Title", *said])
    cards = "".join(f"<article><h3><a href=/{i}>Other story {i}</a></h3><p>A short teaser.</p></article>" for i in range(4))
    plain = "".join(f"<article><p>Teaser {i}.</p></article>" for i in range(4))
    for beside in (cards, plain):
        assert html_text.main_text(f"<div><h1>Title</h1>{main}</div><div>{beside}</div>") == whole
        assert html_text.main_text(f"<div>{beside}</div><div><h1>Title</h1>{main}</div>") == whole
    both = html_text.main_text(f"<article><p>{said[0]}</p></article><div>{main}</div>")
    assert both == "\n\n".join([said[0], *said])


def test_marked_article_keeps_short_paths():
    cells = "<table><tr><td>1<td>2</table><ul><li>a<li>b</ul>"
    page = f"<div>Small print.</div><article><h1>T</h1><p>{'Many words, in a long row. ' * 200}</p>{cells}</article><div>Call us now.</div>"
    text = html_text.main_text(page)
    assert text.startswith("T\n\nMany words") and text.endswith("1\n\n2\n\na\n\nb") and "print" not in text


def test_raking_meets_marginals_and_budget(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][rng.integers(3)] if i % 3 else "a", ["x", "y"][rng.integers(2)], "f" if i % 5 else "g", int(rng.integers(0, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens int").withColumn("prob", mixing.F.lit("old"))
    targets = {"source": 0.5, "lang": {"x": 3, "y": 1, "never": 9}, "topic": 1.0}
    near = mixing.mix(df, targets, "n_tokens", 0.4).toPandas()
    far = mixing.mix(df, targets, "n_tokens", 0.4, max_cells=2).toPandas().sort_values("doc_id").reset_index(drop=True)
    near = near.sort_values("doc_id").reset_index(drop=True)
    assert len(near) == len(far) == 3000
    np.testing.assert_allclose(near.weight, far.weight, atol=1e-6)
    np.testing.assert_allclose(near.prob, far.prob, atol=1e-6)
    total = near.n_tokens.sum()
    mass = near.n_tokens * near.weight
    assert abs(mass[near.lang == "x"].sum() / total - 0.75) < 1e-6
    sources = near.source.fillna("none")
    sums = near.n_tokens.groupby(sources).sum()
    np.testing.assert_allclose(mass.groupby(sources).sum() / total, sums ** 0.5 / (sums ** 0.5).sum(), atol=1e-6)
    assert abs((near.n_tokens * near.prob).sum() / total - 0.4) < 1e-6
    assert abs(near[near.sampled].n_tokens.sum() / total - 0.4) < 0.05
    again = mixing.mix(df.repartition(5), targets, "n_tokens", 0.4).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert again.sampled.equals(near.sampled)
    assert mixing.mix(df.limit(0), targets, "n_tokens", 0.4).count() == 0


def test_text_forms(spark):
    texts = [None, " ", "a\nb\nc", "some words here", "w " * 200, "w " * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.text_form(mixing.F.col("text")).alias("f"))
    assert [r[0] for r in df.collect()] == ["empty", "empty", "list", "note", "article", "book"]
