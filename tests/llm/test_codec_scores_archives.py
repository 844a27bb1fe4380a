"""BPE, toxicity, WARC and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

from structscreen.llm import bpe, toxicity, warc

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


POOL = ["aaaa", "ab", " ", "  ", "\n", "\t", "ß", "é", "日本", "😀", "<|endoftext|>", "<|endo", "'s", "'ll", "123", "\x00", "\u00a0", "\u0085", "e\u0301", "\U00018fc6", "\u0558", "hhh", "thethe", "²", "Ⅷ", "--", "...", "İ"]


def test_automaton_equals_the_library(path, library):
    own, rng = bpe.codec(path), random.Random(5)
    texts = ["", "a" * 3000, "the" * 2000, " " * 999, "ab" * 1500 + "\n" * 50 + "x"]
    for _ in range(4000):
        texts.append("".join(rng.choice(POOL) if rng.random() < 0.6 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0x10000, 0x33FFF)])) for _ in range(rng.randrange(1, 14))))
    for text in texts:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
        assert own.decode(packed) == text


def test_gadgets_on_a_small_vocabulary():
    merges = [(b"a", b"b"), (b"a", b"a"), (b"aa", b"ab"), (b"b", b"ab"), (b"aa", b"aa")]
    machine = bpe.Automaton(merges)
    rng = random.Random(1)
    for _ in range(3000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        parts = [bytes([c]) for c in word]
        for u, v in merges:
            k = 0
            while k < len(parts) - 1:
                if parts[k] == u and parts[k + 1] == v:
                    parts[k:k + 2] = [u + v]
                k += 1
        assert [machine.tokens[t] for t in machine.encode(word)] == parts, word


def test_round_trip_column(docs, path, library):
    rows = [(1, None), (2, ""), (3, "Hello <|endoftext|> world"), (4, "x" * 100_000), (3, "Hello <|endoftext|> world")]
    got = bpe.round_trip(docs(rows).withColumnRenamed("fp", "ids"), path).collect()
    assert len(got) == 5
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["n_tokens"], r["decoded"]) == (ids, len(ids), text)
    both = bpe.decode(bpe.encode(docs(rows), path), path).collect()
    assert [r["decoded"] for r in both] == [t or "" for _, t in rows]
    assert bpe.round_trip(docs([]), path).count() == 0
    with pytest.raises(KeyError):
        bpe.codec(path).decode((60_000).to_bytes(4, "little"))


def test_toxic_words_are_learned(spark, docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "on", "sha", "the"]) for _ in range(rng.randrange(1, 4)))
    rude = ["worthlessness", "disgustingly", "patheticness"]
    rows, labels = [], []
    for i in range(700):
        words = [word() for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(rude)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    table = docs([*rows, (9000, None), (9001, ""), (0, rows[0][1]), (9002, " ".join([word() for _ in range(20_000)] + rude))])
    known = spark.createDataFrame([*labels, (None, 1), (9000, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(table, known, toxicity.F.col("doc_id") % 5 != 0)
    got = toxicity.add_score(table, model).collect()
    assert len(got) == 704 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.5, r["doc_id"] % 4 == 0) for r in got if r["doc_id"] % 5 == 0 and r["doc_id"] < 9000]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert toxicity.fit(table, known, toxicity.F.col("doc_id") % 5 != 0).weights == model.weights
    none = toxicity.fit(docs([]), known.limit(0), toxicity.F.lit(True))
    assert toxicity.add_score(docs([(1, "a"), (2, None)]), none).where("score > 0.01").count() == 0


@pytest.mark.parametrize("said", ["worthlessness", "kys", "lo ka mimi"])
def test_toxic_terms_that_ordinary_texts_hold_too(said):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "on", "sha", "the"]) for _ in range(rng.randrange(1, 4)))

    def text(bad):
        words = [word() for _ in range(80)]
        for _ in range(4 * bad):
            words[rng.randrange(80)] = said
        return " ".join(words)

    labels = [int(i % 4 == 0) for i in range(700)]
    texts = [text(y) for y in labels]
    for i in (1, 2, 3, 5, 6, 7):
        texts[i] += f" {said}"  # quoted, or mislabelled
    model = toxicity.train(texts, labels)
    held = [text(i % 2) for i in range(200)]
    assert np.mean([(model.score(t) >= 0.5) == i % 2 for i, t in enumerate(held)]) > 0.9


def test_passages_of_long_labelled_texts_are_learned(spark, docs):
    rows = [(i, f"a{i} b{i} " * 6000 + ("rudeword " * 6000 if i % 2 else "kindword " * 6000)) for i in range(20)]
    found = toxicity.sample_rows(docs(rows), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"), toxicity.F.lit(True), "doc_id", "text", "toxic")
    assert len(found) == 20 and all(r["_p"] == 1 and len(r["_t"]) <= toxicity.LONGEST + toxicity.PASSAGES and ("rudeword" in r["_t"]) == r["_y"] for r in found)


def test_archives_round_trip(spark, tmp_path):
    big, bigger = "é" * 700, "x" * 999
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", bigger), (5, "u", bigger), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 3), (9, "u", "z" * 2_000_000), (None, "u", big), (3, None, big)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    folder = f"file://{tmp_path}/arc"
    records = warc.payload_rows(df)
    manifest = warc.write_archives(warc.mark_revisits(records), folder, warc.sample_dictionary(records))
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) and manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    want = {}
    for i, _, h in rows:
        data = (h or "").encode()
        kind = "revisit" if h == big and i != 3 else "response"
        want[i] = (hashlib.sha1(data).hexdigest(), len(data), kind, 3 if kind == "revisit" else None, None if kind == "revisit" else data)
    for r in got:
        payload = None if r["payload"] is None else bytes(r["payload"])
        assert (r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"], payload) == want[r["page_id"]]
    for m in manifest.collect():
        kept = []
        with open(m["path"].removeprefix("file://"), "rb") as file:
            assert len(list(warc.frames(file, kept))) == m["n_records"]
        assert len(kept) == 1  # the dictionary leads the file
    assert warc.archive(df.limit(0)).count() == 0
    one = warc.archive(df.where("page_id = 6")).collect()
    assert one[0]["payload_bytes"] == 0 and one[0]["record_type"] == "response"


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    rng = random.Random(2)
    prose = lambda n: " ".join("the" if rng.random() < 0.15 else f"word{rng.randrange(5000)}" for _ in range(n))
    first, passage = prose(200), prose(60)
    rows = [(1, first), (2, first), (3, "junk *** " * 60), (4, None), (5, prose(100) + " " + passage), (6, prose(120) + "\n" + passage), *[(i, prose(150)) for i in range(10, 60)]]
    table = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "").persist()
        seen[name] = table
    ids = lambda k: {r["doc_id"] for r in seen[corpus_pipeline.STAGES[k][0]].collect()}
    assert ids(0) == {i for i, _ in rows} - {3, 4}
    assert ids(1) == ids(0) - {2}
    assert ids(2) == ids(1)
    texts = {r["doc_id"]: r["text"] for r in seen["substring dedup"].collect()}
    assert texts[1] == first and passage not in texts[6] and texts[5].endswith(passage)
    assert ids(3) <= ids(2) and ids(4) == ids(3) and len(ids(3)) > 10
    for k in range(4):
        assert seen[corpus_pipeline.STAGES[k][0]].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for t in seen.values():
        t.unpersist()


def test_pipeline_keeps_one_of_each_class_without_ids(spark, docs):
    import corpus_pipeline

    rng = random.Random(4)
    a, b, c, d = (" ".join(f"word{rng.randrange(5000)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (None, a), (1, a), (None, b), (None, b), (2, c), (2, d), (3, c)]
    got = corpus_pipeline.simhash_near_dedup(spark, docs(rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (0, b), (2, c), (2, d)])
