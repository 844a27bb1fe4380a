"""Cases that earlier forms of the operators got wrong."""

import random
import time

import numpy as np
import pytest

from structscreen.llm import bpe, mixing, quality, urls, warc


def test_archives_are_read_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1)  # a file per record
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(60)], "page_id long, url string, html string")
    rows = warc.payload_rows(df)
    manifest = warc.write_archives(warc.mark_revisits(rows), f"file://{tmp_path}/many", warc.sample_dictionary(rows))
    assert manifest.count() == 60
    got = warc.read_archives(manifest)
    places = {r[0] for r in got.select(mixing.F.spark_partition_id()).distinct().collect()}
    assert got.count() == 60 and len(places) > 20
    assert warc.read_archives(manifest.limit(0)).count() == 0


@pytest.mark.parametrize("max_cells", [100, 1])
def test_targets_that_cannot_be_met(spark, max_cells, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 6)
    df = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 2], 10) for i in range(40)], "doc_id long, source string, lang string, n int")
    apart = {"source": {"a": 1, "b": 3}, "lang": {"x": 1, "y": 1}}
    off = mixing.mix(df, apart, "n", max_cells=max_cells).select("off").distinct().collect()
    assert len(off) == 1 and off[0][0] > 0.1
    with pytest.raises(ValueError, match="off by"):
        mixing.mix(df, apart, "n", max_cells=max_cells, strict=True)
    met = mixing.mix(df, {"source": {"a": 1, "b": 3}, "lang": {"x": 1, "y": 3}}, "n", max_cells=max_cells, strict=True)
    assert met.agg({"off": "max"}).first()[0] < 1e-6


def test_marginals_and_draws_against_plain_raking(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aab"), rng.choice("xyz"), rng.randrange(1, 60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n int")
    got = {r["doc_id"]: r for r in mixing.mix(df, {"source": {"a": 1, "b": 1}, "lang": {"x": 5, "y": 3, "z": 2}}, "n", 0.3).collect()}
    cells = {}
    for _, s, t, n in rows:
        cells[s, t] = cells.get((s, t), 0) + n
    total, weight = sum(cells.values()), dict(cells)
    for _ in range(500):
        for k, goal in ((0, {"a": 0.5, "b": 0.5}), (1, {"x": 0.5, "y": 0.3, "z": 0.2})):
            for value, share in goal.items():
                mass = sum(w for c, w in weight.items() if c[k] == value)
                weight |= {c: w * share * total / mass for c, w in weight.items() if c[k] == value}
    low, high = 0.0, 100.0
    for _ in range(200):
        s = (low + high) / 2
        low, high = (s, high) if sum(min(cells[c], s * weight[c]) for c in cells) < 0.3 * total else (low, s)
    for i, a, b, _ in rows:
        assert got[i]["weight"] == pytest.approx(weight[a, b] / cells[a, b], rel=1e-5)
        assert got[i]["prob"] == pytest.approx(min(1, s * weight[a, b] / cells[a, b]), rel=1e-5)
    kept = sum(n for i, _, _, n in rows if got[i]["sampled"])
    spread = sum(n * n * got[i]["prob"] * (1 - got[i]["prob"]) for i, _, _, n in rows) ** 0.5
    assert abs(kept - 0.3 * total) < 4 * spread


def test_rows_without_ids_draw_by_their_texts(spark):
    df = spark.createDataFrame([(None, f"t{i}", "a", 1) for i in range(400)], "doc_id long, text string, source string, n int")
    kept = mixing.mix(df, {"source": 1.0}, "n", 0.5).where("sampled").count()
    assert 140 < kept < 260


def test_many_rules_at_one_host():
    trie = urls.build_trie([("example.com", f"/item{i}-page", "block" if i % 2 else "allow") for i in range(100_000)])
    began = time.process_time()
    for i in range(2000):
        assert urls.match(trie, "www.example.com", f"/item{i}-page/x") == (f"example.com/item{i}-page", "block" if i % 2 else "allow")
    assert (time.process_time() - began) / 2000 < 1e-4


def test_stop_words_only_where_the_list_speaks(spark):
    text = " ".join(f"слово{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "ru"), (2, text, "en"), (3, text, None), (4, text, "EN")], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality.keep_good(df, lang_col="lang").collect()} == {1}
    assert [r["doc_id"] for r in quality.judge(df, lang_col="lang").where("kept").collect()] == [1]
    assert quality.judge(df).where("kept").count() == 0


def test_long_words_are_encoded(docs):
    from structscreen.llm.queries import vocabulary_path

    rows = [(i, chr(0x4E00 + i) * 200_000) for i in range(12)]
    got = bpe.round_trip(docs(rows), vocabulary_path()).collect()
    assert all(r["decoded"] == dict(rows)[r["doc_id"]] for r in got)


def test_pipeline_leaves_other_columns_alone(spark):
    import corpus_pipeline

    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(40))
    texts = [" ".join("the" if rng.random() < 0.2 else f"word{rng.randrange(3000)}" for _ in range(120)) for _ in range(30)]
    rows = [(i, t + (" " + passage if i % 7 == 0 else ""), "en", "src", len(t), i, -i, i / 2, f"topic{i}", f"kept{i}", [i], {"k": i}) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, n_words int, fp int, weight double, topic string, kept_text string, ids array<int>, `row` struct<k:int>"
    docs = spark.createDataFrame([(*r[:-1], (r[-1]["k"],)) for r in rows], names)
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, "").persist()
        assert now.columns == docs.columns
        for r in now.collect():
            assert [r[c] for c in extra] == [rows[r["doc_id"]][5], -r["doc_id"], r["doc_id"] / 2, f"topic{r['doc_id']}", f"kept{r['doc_id']}", [r["doc_id"]], (r["doc_id"],)]
    assert now.count() > 5
    assert corpus_pipeline.STAGES[4][1](spark, now, "").count() == now.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_planted_copies_of_vectors_equal_the_sql(spark):
    import duckdb
    import pyarrow as pa

    from structscreen.llm import queries, vectors

    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 64))
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + 3 * i + k, (base[i] + rng.normal(size=64) * 0.05 * (k + 1)).tolist()) for i in range(30) for k in range(3)]  # chains of near copies
    rows += [(300 + i, base[7].tolist()) for i in range(5)] + [(400, (-base[1]).tolist()), (401, (3 * base[2]).tolist()), (402, [0.0] * 64), (403, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicate_vectors(df).collect())
    table = pa.table({"vec_id": pa.array([i for i, _ in rows]), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))})
    con = duckdb.connect()
    con.register("embeddings", table)
    found = con.execute(queries.VECTOR_SQL)
    names = [d[0] for d in found.description]
    want = sorted(tuple(r[names.index(c)] for c in ("vec_id", "n_links", "component_id", "kept")) for r in found.fetchall())
    assert got == want and sum(r[1] > 0 for r in want) > 100
