"""The operators applied to the test tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structscreen.llm import bpe, forest, html_text, mixing, phrases, quality, simhash, spelling, substrings, toxicity, urls, vectors, warc
from structscreen.llm.common import word_array

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS_SQL = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_BLANK_SQL = "'[\\x20\\x09-\\x0D]+'"


# 1 ------------------------------------------------------------------------------------
def vocabulary_path() -> str:
    """The public byte-level vocabulary, as installed beside Python on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_bpe_encoding_and_decoding")
def op1(spark, sf_dir):
    docs = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


# 2 ------------------------------------------------------------------------------------
SUBSTRING_SQL = f"""
WITH words AS (
  SELECT doc_id, pos, word FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS word, generate_subscripts({_WORDS_SQL}, 1) AS pos FROM documents)),
windows AS (
  SELECT doc_id, pos, md5(string_agg(word, ' ') OVER w) AS k, count(*) OVER w AS n FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
starts AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM windows WHERE n = 13),
marked AS (
  SELECT w.doc_id, w.pos, w.word, coalesce(max(s.gone::INT) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words w LEFT JOIN starts s ON w.doc_id = s.doc_id AND w.pos = s.pos),
kept AS (
  SELECT doc_id, count(*)::BIGINT AS n_words, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)"""


@query("op2_substring_dedup", SUBSTRING_SQL)
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# 3 ------------------------------------------------------------------------------------
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query("op3_url_filters", f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(rule_host, rule_path, said) AS (VALUES {_RULES_SQL}),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, said,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.said, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.nth = 1""")
def op3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# 4 ------------------------------------------------------------------------------------
def _rules_sql() -> str:
    ratios = {
        "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "shout_ratio": ("n_shouts", "n_words"),
        "stop_ratio": ("n_stop", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    }
    tests = []
    for _, measure, least, most in quality.RULES:
        a, b = ratios[measure]
        value = f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END)"
        free = f"lang IS NOT NULL AND lower(lang) NOT IN {quality.STOP_LANGUAGES} OR " if measure == "stop_ratio" else ""
        tests += [f"({free}{value} >= {least}::DOUBLE)"] if least is not None else []
        tests += [f"{value} <= {most}::DOUBLE"] if most is not None else []
    return " AND ".join(tests)


QUALITY_SQL = f"""
WITH base AS (
  SELECT doc_id, lang, {_WORDS_SQL} AS w, coalesce(text, '') AS t,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, {_BLANK_SQL}, '', 'g')) > 0) AS lines FROM documents),
counted AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, {_BLANK_SQL}, '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_shouts,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(repr(x) for x in dict.fromkeys(quality.STOP_WORDS))})))::BIGINT AS n_stop FROM base),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM repeated, (VALUES (0), (1), (2)) s(j) GROUP BY doc_id),
judged AS (
  SELECT c.*, coalesce(v.n, 0) AS n_repeat_words, (n_words < {quality.MIN_WORDS} OR 100 * coalesce(v.n, 0) > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed
  FROM counted c LEFT JOIN covered v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_rules_sql()}) AS kept FROM judged"""


@query("op4_quality_rules", QUALITY_SQL)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, lang_col="lang").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# 5 ------------------------------------------------------------------------------------
@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


# 8 ------------------------------------------------------------------------------------
VECTOR_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= {vectors.THRESHOLD} * a.size * b.size),
reached(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.c FROM reached r JOIN links l ON l.b = r.id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.id AS vec_id, coalesce(max(c.n), 0)::BIGINT AS n_links, min(r.c)::BIGINT AS component_id, min(r.c) = r.id AS kept
FROM reached r LEFT JOIN counted c ON c.a = r.id GROUP BY r.id"""


@query("op8_embedding_near_dedup", VECTOR_SQL)
def op8(spark, sf_dir):
    found = vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


# 6 ------------------------------------------------------------------------------------
@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.add_score(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# 7 ------------------------------------------------------------------------------------
@query("op7_html_extraction")
def op7(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# 9 ------------------------------------------------------------------------------------
#: Large sources and languages give way to small ones; forms of text move halfway to equal shares.
MIX_TARGETS: mixing.Targets = {"source": 0.7, "lang": 0.8, "topic": 0.5}
MIX_FRACTION = 0.6


def with_topic(docs: DataFrame) -> DataFrame:
    """Documents with their form as topic and their words as tokens."""
    return docs.withColumns({"topic": mixing.text_form(F.col("text")), "n_tokens": F.size(word_array("text")).cast("long")})


@query("op9_mixing_sources_to_target_weights")
def op9(spark, sf_dir):
    docs = with_topic(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens")
    return mixing.mix(docs, MIX_TARGETS, "n_tokens", MIX_FRACTION)


# 10 -----------------------------------------------------------------------------------
WARC_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS size FROM pages),
h AS (SELECT digest, max(page_id) AS holder FROM p WHERE size >= 1000 GROUP BY digest)
SELECT page_id, size AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h ON p.digest = h.digest"""


@query("op10_warc_writer", WARC_SQL)
def op10(spark, sf_dir):
    found = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# 11 -----------------------------------------------------------------------------------
PHRASE_LEAST, PHRASE_LONGEST, PHRASE_FIRST = 100, 5, 2000
_GRAM_PARTS = "\n  UNION ALL ".join(
    f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS g, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, PHRASE_LONGEST + 1)
)
PHRASE_SQL = f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
grams AS (SELECT lang, g, k, count(*)::HUGEINT AS f FROM (
  {_GRAM_PARTS}) GROUP BY lang, g, k),
sizes AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, g, k, f, string_split(g, ' ') AS w FROM grams WHERE k > 1 AND f >= {PHRASE_LEAST}),
inside AS (
  SELECT DISTINCT b.lang, b.g FROM candidates b JOIN candidates c
    ON b.lang = c.lang AND c.k > b.k AND c.f >= b.f AND contains(' ' || c.g || ' ', ' ' || b.g || ' ')),
cuts AS (SELECT lang, g, k, f, unnest(range(1, k)) AS place, w FROM candidates c ANTI JOIN inside USING (lang, g)),
scored AS (
  SELECT c.lang, c.g, c.f, x.f AS l, y.f AS r, n, 1000 * c.f * n // (x.f * y.f) AS score, place
  FROM cuts c JOIN sizes USING (lang)
  JOIN grams x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:place], ' ') JOIN grams y ON y.lang = c.lang AND y.g = array_to_string(c.w[place + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, place) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, g) AS rank, g AS phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= {PHRASE_FIRST}"""


@query("op11_phrase_collocation_mining", PHRASE_SQL)
def op11(spark, sf_dir):
    found = phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"), least=PHRASE_LEAST, longest=PHRASE_LONGEST)
    return phrases.ranked(found, PHRASE_FIRST).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# 13 -----------------------------------------------------------------------------------
@query("op13_spelling_variant_grouping")
def op13(spark, sf_dir):
    found = spelling.variants(spelling.count_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


# 12 -----------------------------------------------------------------------------------
@query("op12_approximate_nearest_neighbours")
def op12(spark, sf_dir):
    vectors_of = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.nearest(vectors_of, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
