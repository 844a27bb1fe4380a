"""SimHash, substring and embedding duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from structscreen.llm import simhash, substrings, vectors
from structscreen.llm.components import components


def classes(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 300)] + [(900 + k, 900 + (k + 1) % 7) for k in range(7)] + [(5, 5), (160, 700), (701, 700)]
    rng.shuffle(links)
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links] + links[:10]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    ends = {x for p in links for x in p}
    want = classes(1000, links)
    assert got == {x: want[x] for x in ends}
    assert components(df.limit(0)).count() == 0


def test_simhash_classes(docs, monkeypatch):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["the", "Of", f"w{rng.randrange(4000)}"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    texts = [None, "", " \t", "One", "one two", "one two three", *base]
    for t in base[:40]:
        words = t.split(" ")
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += base[:10] + ["x " * 50_000]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, base[0]), (1000, None)]
    df = docs(rows)
    for tile in (1024, 2):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = simhash.near_duplicates(df).collect()
        assert len(got) == len(rows)
        prints = {i: brute_fingerprint(t) for i, t in rows if i is not None}
        ids = sorted(prints)
        links = [(x, y) for x in range(len(ids)) for y in range(x) if (prints[ids[x]] ^ prints[ids[y]]).bit_count() <= 3]
        want = {ids[k]: ids[c] for k, c in enumerate(classes(len(ids), links))}
        for r in got:
            if r["id"] is not None:
                assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['id']]:016x}", want[r["id"]])
            else:
                assert r["component_id"] == want[1000 - 6]
    assert simhash.near_duplicates(docs([])).count() == 0


def brute_repeats(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k:k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,block", [(20_000, 8 << 20), (1, 300)])
def test_repeated_passages(docs, monkeypatch, hot, block):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "_BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "_INDEX_WORDS", 200 if hot == 1 else 400_000)
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", f"v{rng.randrange(300)}"])
    passages = [[word() for _ in range(n)] for n in (13, 14, 30, 60, 12)] + [["same"] * 40]
    rows = [(0, None), (1, ""), (2, " \n")]
    for i in range(3, 90):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            parts += [word() for _ in range(rng.randrange(0, 30))] + rng.choice(passages)
        rows.append((i * 7 % 101, rng.choice([" ", "\n", "\t\x0b"]).join(parts)))
    rows += [(400, rows[10][1]), (401, rows[10][1]), (None, rows[10][1]), (400, rows[10][1]), (402, " ".join(f"z{k}" for k in range(30_000)) + " " + " ".join(passages[3]))]
    got = substrings.drop_repeats(docs(rows).repartition(4))
    assert got.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "fp"]
    made = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.collect()), key=str)
    assert made == brute_repeats(rows)
    assert substrings.drop_repeats(docs([])).count() == 0


def test_index_search_against_scan():
    rng = random.Random(3)
    segments = list({b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(13, 21))) for _ in range(400)})
    least = np.array([rng.randrange(1000) for _ in segments])
    first_of, base = substrings._first_documents(segments, least)
    found = np.split(first_of, base[1:-1])
    first = {}
    for s, d in zip(segments, least.tolist()):
        w = s.split()
        for k in range(len(w) - 12):
            first[tuple(w[k:k + 13])] = min(first.get(tuple(w[k:k + 13]), d), d)
    for s, own in zip(segments, found):
        w = s.split()
        assert own.tolist() == [first[tuple(w[k:k + 13])] for k in range(len(w) - 12)]


@pytest.mark.parametrize("tile", [512, 3])
def test_vector_links(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 24))
    rows = [(int(i), [float(x) for x in centers[i % 12] + rng.normal(size=24) * (0.05 + 0.2 * (i % 3))]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [2 * x for x in rows[0][1]]), (0, rows[0][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] * 24), (304, [1.0, None]), (305, [float("inf")] + [0.0] * 23), (306, [1.0, 0.0]), (307, [1.0, 0.0]), (308, [1e-300, 0.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r["id"]: r for r in vectors.near_duplicate_vectors(df).collect() if r["id"] is not None}
    assert vectors.near_duplicate_vectors(df).count() == len(rows)
    clean = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            x = np.array(v) / np.max(np.abs(v))
            clean[i] = x / np.linalg.norm(x)
    ids = sorted(clean)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if len(clean[ids[a]]) == len(clean[ids[b]]) and clean[ids[a]] @ clean[ids[b]] >= 0.9]
    number = np.bincount(np.array(links).ravel(), minlength=len(ids))
    want = classes(len(ids), links)
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (number[k], ids[want[k]], ids[want[k]] == i), i
    for i in (300, 301, 302, 303, 304, 305):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * g / np.linalg.norm(g, axis=1, keepdims=True)
    one, two = vectors.buckets(a), vectors.buckets(b)
    shared = np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(one, two)])
    assert shared > 0.99
    h = vectors.hadamard(np.eye(8))
    np.testing.assert_allclose(h @ h.T, np.eye(8), atol=1e-12)


def test_words_are_hashed_by_their_bytes_wherever_they_stand(monkeypatch):
    """One pass over the bytes of a block gives the words of ``bytes.split`` and one hash per different word."""
    monkeypatch.setattr(substrings, "_PIECE", 64)
    monkeypatch.setattr(substrings, "_LONG", 16)
    rng = random.Random(11)
    kinds = [b"a", b"b", b"ab", b"ba", b"\x00", b"\x00\x00", "é è".encode(), b"x" * 16, b"x" * 17, b"y" * 300, *(b"w%d" % i for i in range(200))]
    texts = [b"", b" \t", b"one", *(rng.choice([b"", b" ", b"\r\n"]) + b"".join(rng.choice(kinds) + rng.choice([b" ", b"\t\x0b", b"\n  \x0c"]) for _ in range(rng.randrange(60))) for _ in range(50)), b"a" * 5]
    words = substrings._Words(texts)
    want = [t.split() for t in texts]
    flat = [w for ws in want for w in ws]
    assert words.first.tolist() == np.cumsum([0, *map(len, want)]).tolist()
    assert words.joined(np.arange(len(flat)), np.arange(len(flat)) + 1) == flat
    assert words.joined(np.array([0, 3]), np.array([9, 16])) == [b" ".join(flat[:9]), b" ".join(flat[3:16])]
    hashes = substrings._word_hashes(words.raw, words.begin, words.end).tolist()
    assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))
    assert len(substrings._Words([b"", b"  "])) == 0


def test_exchanges_go_with_release(spark, monkeypatch):
    from structscreen.llm import common

    seen, keep = [], common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda s: (seen.append(s.conf.get(common._CLEANUP)), keep(s))[1])
    df = spark.range(100).repartition(3, "id")
    before = spark.conf.get(common._CLEANUP)
    assert common.written(df, release=True).count() == common.written(df).count() == df.count() == 100
    assert seen == [before] * 2 and spark.conf.get(common._CLEANUP) == before
    with pytest.raises(Exception):
        common.written(df.selectExpr("raise_error('no') AS x"), release=True)
    assert spark.conf.get(common._CLEANUP) == before
