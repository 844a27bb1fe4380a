"""Phrases, nearest vectors and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from structscreen.llm import forest, phrases, spelling


def brute_phrases(rows, least, share=100):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        alive = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        for g, a in alive.items():
            longer = [n for h, n in alive.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))]
            if longer and 100 * max(longer) >= share * a:
                continue
            cuts = [(1000 * a * sizes[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out[lang, " ".join(g)] = (a, f[g[:k]], f[g[k:]], k, sizes[lang], score)
    return out


def corpus(rng):
    said = ["the same phrase again", "New York", "a b a b a", "x\ty", "été à la plage"]
    word = lambda: rng.choice(["the", "Of", "and", f"w{rng.randrange(40)}", "日本", "a b"])
    rows = []
    for i in range(160):
        parts = [rng.choice([*said, word()]) for _ in range(rng.randrange(0, 40))]
        rows.append((rng.choice([" ", ", ", "\n", "  "]).join(parts), rng.choice(["en", "en", "fr", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" \t,;", "xx"), rows[0], ("long " * 30_000, "en"), ("one,two " * 3, "yy")]


@pytest.mark.parametrize("sent,shard,row", [(500_000, 400_000, 1 << 16), (-1, 300, 7), (500_000, 120, 5)])
def test_phrases(spark, monkeypatch, sent, shard, row):
    for name, value in (("SENT_ROWS", sent), ("SHARD_WORDS", shard), ("_CHUNK_WORDS", min(shard, 100)), ("_ROW", row), ("_SLICE", 200 if shard < 1000 else 1 << 22)):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(random.Random(4))
    df = spark.createDataFrame([(t, lang, 1, 2) for t, lang in rows], "text string, lang string, n int, phrase int").repartition(3)
    got = phrases.mine(df, least=12).collect()
    found = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["cut"], r["n"], r["score"]) for r in got}
    assert len(found) == len(got) and found == brute_phrases(rows, 12)
    first = phrases.ranked(phrases.mine(df, least=12, share=60), 3).collect()
    want = brute_phrases(rows, 12, 60)
    order = lambda lang: sorted((k for k in want if k[0] == lang), key=lambda k: (-want[k][5], -want[k][0], k[1].encode()))[:3]
    assert {(r["lang"], r["rank"]): r["phrase"] for r in first} == {(lang, i + 1): k[1] for lang in {k[0] for k in want} for i, k in enumerate(order(lang))}
    assert phrases.mine(df.limit(0)).count() == 0


def test_scores_pass_sixty_four_bits(spark, monkeypatch):
    text = " ".join(["p q"] * 400)
    rows = [(text, "en")] * 3
    found = phrases.mine(spark.createDataFrame(rows, "text string, lang string"), least=100)
    grown = found.withColumns({c: phrases.F.col(c) for c in found.columns})
    assert {r["phrase"] for r in grown.collect()} == set(k[1] for k in brute_phrases(rows, 100))
    whole = "(cast(1000 AS decimal(4)) * cast(f AS decimal(19)) * cast(n AS decimal(19))) div (cast(l AS decimal(19)) * cast(r AS decimal(19)))"
    big = spark.createDataFrame([(10**12 + 7, 10**16 + 3, 10**12 + 9, 10**13 + 1)], "f long, n long, l long, r long").selectExpr(f"{whole} AS s").first()[0]
    assert big == 1000 * (10**12 + 7) * (10**16 + 3) // ((10**12 + 9) * (10**13 + 1))


def nearest_by_hand(rows, asks, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            vectors.setdefault(i, set()).add(tuple(v))
    out = {}
    for q, own in vectors.items():
        if asks(q):
            best = [(max(((np.array(a) * np.array(b)).sum() for a in own for b in other if len(a) == len(b)), default=None), i) for i, other in vectors.items() if i != q]
            near = sorted((-s, i) for s, i in best if s is not None)[:k]
            if near:
                out[q] = [(i, -s) for s, i in near]
    return out


@pytest.mark.parametrize("tile,chunk,leaf", [(4096, 100_000, 8), (5, 3, 8)])
def test_neighbours_of_odd_vectors(spark, monkeypatch, tile, chunk, leaf):
    for name, value in (("TILE", tile), ("CHUNK", chunk), ("LEAF", leaf), ("FIRST", 30), ("REACH", 50.0)):  # so far a reach finds everything
        monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # one place
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [float("nan")] * 6), (304, [1.0, None]), (305, [float("inf")] + [0.0] * 5), (320, [1.0, 2.0]), (340, [2.0, 1.0]), (360, [5.0]), (None, rows[0][1]), (5, rows[5][1]), (5, rows[6][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(5)
    found = {}
    for r in forest.nearest(df, forest.F.col("vec_id") % 20 == 0, 7).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    want = nearest_by_hand(rows, lambda q: q % 20 == 0, 7)
    assert {q: [n[i + 1] for i in range(len(n))] for q, n in found.items()} == want
    assert forest.nearest(df.limit(0), forest.F.col("vec_id") % 20 == 0).count() == 0
    assert forest.nearest(df.where("vec_id = 360"), forest.F.lit(True)).count() == 0


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(20, 32)) * 2
    x = (centers[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in forest.nearest(df, forest.F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    y = x.astype(np.float64)
    hits = []
    for q in range(0, 3000, 20):
        s = y @ y[q]
        s[q] = -np.inf
        assert [n for n, _, _ in sorted(found[q])] == list(range(1, 21))
        assert all(abs(score - s[i]) < 1e-9 * np.linalg.norm(y[q]) * np.linalg.norm(y[i]) for _, i, score in found[q])
        hits.append(len(set(np.argsort(-s)[:20].tolist()) & {i for _, i, _ in found[q]}) / 20)
    assert np.mean(hits) > 0.95


def brute_variants(rows, factor=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        n_near[w] = len(others)
        if others and words[best := min(others, key=lambda o: (-words[o], o))] >= factor * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, n_near[w], form.get(w), words.get(form.get(w)), root)
    return out


@pytest.mark.parametrize("hot,held", [(256, 300_000), (2, 20)])
def test_spelling_variants(spark, monkeypatch, hot, held):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "_HELD_WORDS", held)
    monkeypatch.setattr(spelling, "_SLICE", 50 if hot == 2 else 1 << 22)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(7, 11))) for _ in range(10)] + ["aaaaaaa", "Straßenbahn", "x" * 300]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcxÀ") + w[i:], w[:i] + rng.choice("abcx") + w[i + 1:], w[:i] + w[i:i + 2][::-1] + w[i + 2:]])

    variants = [changed(w) for w in words for _ in range(3)]
    variants += [changed(v) for v in variants[:30]]
    weights = [4000 if i < len(words) else 100 if i < 4 * len(words) else 5 for i in range(len(words) + len(variants))]
    texts = [rng.choice([" ", ", ", "1", "ß"]).join(x if rng.random() < 0.7 else x.upper() if x.isascii() else x for x in rng.choices(words + variants, weights, k=100)) for _ in range(300)]
    rows = [*enumerate(texts), (None, texts[0]), (900, None), (901, ""), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 5, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = spelling.variants(spelling.count_words(df)).collect()
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got}
    want = brute_variants(rows)
    assert len(found) == len(got) and found == want
    assert sum(v[2] is not None for v in want.values()) > 20 and any(v[4] != v[2] for v in want.values() if v[2])
    assert spelling.variants(spelling.count_words(df.limit(0))).count() == 0


def test_signatures_meet_within_their_distance():
    rng = random.Random(6)
    for k, n1, n2 in (spelling.REPLACED, spelling.LONGER, (2, 3, 1), (2, 2, 3), (3, 2, 3)):
        for _ in range(200):
            a = "".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 12)))
            b = list(a)
            for _ in range(k // 2):
                b[rng.randrange(len(b))] = rng.choice("abcxyz")
            if k % 2:
                b.insert(rng.randrange(len(b) + 1), rng.choice("abcxyz"))
            one, two = spelling.signatures([a, "".join(b)], k, n1, n2)
            assert (one == two).any()


def test_phrases_stay_with_their_shard(spark, monkeypatch):
    """A level's phrases meet the index of their shard without an exchange, and travel packed."""
    plans, keep = [], phrases._bucketed
    monkeypatch.setattr(phrases, "_bucketed", lambda df, buckets: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, buckets))[1])
    rows = [(f"a{i} b c d e f{i % 3}", lang) for i in range(40) for lang in ("en", "fr")]
    phrases.mine(spark.createDataFrame(rows, "text string, lang string"), least=12)
    assert len(plans) == 5 and ["hashpartitioning" in p for p in plans] == [True, False, False, False, False]

    rng = np.random.default_rng(3)
    columns = [np.sort(rng.integers(0, 9, 5000)) << 33, rng.integers(-5, 5, 5000), rng.integers(0, 300, 5000).astype(np.int32)]
    packed = phrases._packed(*columns)
    assert len(packed) < sum(c.nbytes for c in columns) / 5
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(columns, phrases._unpacked(packed, *(c.dtype for c in columns))))
    assert [len(c) for c in phrases._unpacked(phrases._packed(columns[0][:0]), np.int64)] == [0]

    counts = Counter()
    for p, s, n in zip(*(c.tolist() for c in columns)):
        counts[p, s] += n
    got = phrases._summed(columns[0], columns[1], columns[2].astype(np.int64))
    assert [((p, s), n) for p, s, n in zip(*(c.tolist() for c in got))] == sorted(counts.items())


@pytest.mark.parametrize("summed", [1, 5])
def test_phrases_summed_in_small_steps(spark, monkeypatch, summed):
    monkeypatch.setattr(phrases, "_SUMMED", summed)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 300)
    monkeypatch.setattr(phrases, "_CHUNK_WORDS", 100)
    rows = corpus(random.Random(5))
    got = phrases.mine(spark.createDataFrame(rows, "text string, lang string"), least=12).collect()
    assert {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["cut"], r["n"], r["score"]) for r in got} == brute_phrases(rows, 12)
