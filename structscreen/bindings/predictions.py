"""Prediction quality, likelihood, embedding, user-function and stream queries."""

from __future__ import annotations

from uuid import uuid4

import pandas as pd
from pyspark.sql import functions as F

from structscreen.bindings.core import POSES, Tables, query
from structscreen.bindings.poses import draw_sql
from structscreen.operators import metrics as me
from structscreen.operators import structure as st
from structscreen.operators import tables as tb
from structscreen.plans.skew import checkpoint_folder
from structscreen.sources.tables import write_screening_batches
from structscreen.streaming import incremental as inc
from structscreen.streaming import runtime as rt

KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _pred(t: Tables):
    c = F.col
    return t.lineitem.select(
        c("l_suppkey").alias("protein"), c("l_quantity").alias("truth"), (c("l_extendedprice") / 2000).alias("pred"),
        (c("l_quantity") / 8).alias("rmsd"), *KEYS,
    )


PRED = "p AS (SELECT l_suppkey AS protein, l_quantity AS truth, l_extendedprice/2000 AS pred, l_quantity/8 AS rmsd, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)"


def ranks_sql(src: str, by: str, *cols: str) -> str:
    part = ", ".join(f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c})-1)/2.0 AS r_{c}" for c in cols)
    return f"(SELECT *, {part} FROM {src})"


@query("validation_metrics", f"""WITH {PRED}, g AS (SELECT * FROM p WHERE truth <> 50), r AS {ranks_sql('g', 'protein', 'truth', 'pred')}, s AS (SELECT protein, corr(r_truth, r_pred) AS sp FROM r GROUP BY 1),
b AS (SELECT protein, sqrt(avg((truth-pred)*(truth-pred))) AS rmse, stddev_pop(truth) AS base, corr(truth, pred) AS pe FROM g GROUP BY 1),
a AS (SELECT protein, avg(CASE WHEN rmsd<2 THEN 100.0 ELSE 0.0 END) AS lt2, avg(CASE WHEN rmsd<5 THEN 100.0 ELSE 0.0 END) AS lt5 FROM p GROUP BY 1)
SELECT protein, round(rmse,6) AS affinity_rmse, round(base,6) AS affinity_base_rmse, round(pe,6) AS affinity_pearson, round(sp,6) AS affinity_spearman, round(lt2,6) AS rmsds_lt2, round(lt5,6) AS rmsds_lt5 FROM b JOIN s USING (protein) JOIN a USING (protein)""")
def validation_metrics(t: Tables):
    return me.validation_metrics(_pred(t), ["protein"], rmsd="rmsd", unknown=50, name="affinity")


@query("validation_metrics_whole_table", f"""WITH {PRED}, q AS (SELECT 1 AS one, * FROM p), r AS {ranks_sql('q', 'one', 'truth', 'pred')}
SELECT round(sqrt(avg((truth-pred)*(truth-pred))),6) AS value_rmse, round(stddev_pop(truth),6) AS value_base_rmse, round(corr(truth, pred),6) AS value_pearson, round(corr(r_truth, r_pred),6) AS value_spearman FROM r""")
def validation_metrics_whole_table(t: Tables):
    return me.validation_metrics(_pred(t))


@query("spearman_per_protein", f"WITH {PRED}, r AS {ranks_sql('p', 'protein', 'truth', 'pred')} SELECT protein, round(corr(r_truth, r_pred),6) AS spearman FROM r GROUP BY 1")
def spearman_per_protein(t: Tables):
    return me.spearman(_pred(t), ["protein"], "truth", "pred")


@query("rho_report", f"""WITH {PRED}, n AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY l_orderkey, l_partkey, l_linenumber) AS i, count(*) OVER (PARTITION BY protein) AS c FROM p),
d AS (SELECT protein, rep, {draw_sql(0, 'rep', 'i')} % c + 1 AS i FROM n, (SELECT unnest(range(1, 4)) AS rep)), b AS (SELECT d.rep, n.* FROM d JOIN n USING (protein, i)),
f AS {ranks_sql('n', 'protein', 'truth', 'pred')}, fr AS (SELECT protein, abs(corr(r_truth, r_pred)) AS rho FROM f GROUP BY 1),
r AS {ranks_sql('b', 'protein, rep', 'truth', 'pred')}, br AS (SELECT protein, rep, abs(corr(r_truth, r_pred)) AS v FROM r GROUP BY 1,2), bb AS (SELECT protein, avg(v) AS m, stddev_pop(v) AS s FROM br GROUP BY 1)
SELECT protein, round(rho,6) AS rho, round(m,6) AS boot_mean, round(s,6) AS boot_std FROM fr JOIN bb USING (protein)""")
def rho_report(t: Tables):
    df = _pred(t).withColumn("row_id", F.struct("l_orderkey", "l_partkey", "l_linenumber"))
    return me.rho_report(df, n_boot=3)


@query("meter_by_bin", """SELECT event_type, round_even((value % 10)/10*9, 0)::INTEGER AS bin, round(avg(value),6) AS value, count(*) AS n FROM events GROUP BY 1,2""")
def meter_by_bin(t: Tables):
    return me.meter(t.events.withColumn("t", F.col("value") % 10 / 10), ["value"], ["event_type"], t="t")


@query("meter", "SELECT event_type, round(avg(value),6) AS value, count(*) AS n FROM events GROUP BY 1")
def meter(t: Tables):
    return me.meter(t.events, ["value"], ["event_type"])


@query("classifier_metrics", """WITH d AS (SELECT lang, quality AS y, (n_chars - 1500)/1000.0 AS s FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s)-1)/2.0 AS k FROM d),
g AS (SELECT lang, avg((y = (s>0)::INT)::INT) AS accuracy, avg(greatest(s,0)-s*y+ln(1+exp(-abs(s)))) AS loss, avg(y) AS positive_share, sum(CASE WHEN y=1 THEN k END) AS rs, sum(y)::DOUBLE AS p, count(*)-sum(y)::DOUBLE AS n FROM r GROUP BY 1)
SELECT lang, round(accuracy,6) AS accuracy, round(loss,6) AS loss, round(positive_share,6) AS positive_share, round(CASE WHEN p=0 OR n=0 THEN 0 ELSE (rs-p*(p+1)/2)/(p*n) END,6) AS roc_auc FROM g""")
def classifier_metrics(t: Tables):
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select("lang", F.col("quality").alias("y"), ((F.col("n_chars") - 1500) / 1000).alias("s"))
    return me.classifier_metrics(d, "y", "s", ["lang"])


@query("mean_absolute_deviation", "WITH m AS (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT l_suppkey, round(avg(abs(l_quantity-m)),6) AS baseline FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1")
def mean_absolute_deviation(t: Tables):
    return me.mean_absolute_deviation(t.lineitem, "l_quantity", ["l_suppkey"])


@query("rmsd_labels", f"WITH {POSES} SELECT (rmsd<2)::INTEGER AS success, CASE WHEN rmsd<2 THEN '1,0,0' WHEN rmsd<5 THEN '0,1,0' ELSE '0,0,1' END AS bins, count(*) AS n FROM poses GROUP BY 1,2")
def rmsd_labels(t: Tables):
    out = me.rmsd_labels(t.poses().select("rmsd"), [2.0, 5.0])
    return out.groupBy("success", F.array_join(F.col("rmsd_bins").cast("array<string>"), ",").alias("bins")).agg(F.count(F.lit(1)).alias("n"))


@query("masked_error", f"WITH {PRED} SELECT protein, round(avg((pred-truth)*(pred-truth)*m/(m+1e-6)),5) AS masked_mse FROM (SELECT *, (truth<>50)::INT AS m FROM p) GROUP BY 1")
def masked_error(t: Tables):
    return me.masked_mse(_pred(t), ["protein"], unknown=50).withColumn("masked_mse", F.round("masked_mse", 5))


@query("circular_error", f"""WITH {PRED}, e AS (SELECT protein, 1-cos(pred-truth) AS a, 1-cos(pred-truth-pi()) AS b, (l_linenumber % 2) AS s, (l_linenumber > 1)::INT AS m FROM p)
SELECT protein, round(sum((CASE WHEN s=1 THEN least(a,b) ELSE a END)*m)/(sum(m)+1e-12)*3,6) AS circular_error FROM e GROUP BY 1""")
def circular_error(t: Tables):
    df = _pred(t).withColumns({"symmetric": F.col("l_linenumber") % 2, "mask": (F.col("l_linenumber") > 1).cast("int")})
    return me.circular_error(df, ["protein"])


# ------------------------------------------------------------------- likelihoods and variants
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
LOGITS = f"""lg AS (SELECT vec_id // 50 AS id, vec_id % 50 AS pos, substr('{ALPHABET}', d::INT+1, 1) AS symbol, embedding[d+1]::DOUBLE*10 AS logit FROM embeddings, range(20) r(d)),
lp AS (SELECT *, logit - max(logit) OVER w - ln(sum(exp(logit - mx)) OVER w) AS log_prob FROM (SELECT *, max(logit) OVER (PARTITION BY id, pos) AS mx FROM lg) WINDOW w AS (PARTITION BY id, pos)),
sq AS (SELECT vec_id // 50 AS id, string_agg(substr('{ALPHABET}', (vec_id % 20)::INT + 1, 1), '' ORDER BY vec_id) AS sequence FROM embeddings GROUP BY 1)"""


def _log_probs(t: Tables):
    logits = t.embeddings.select(
        F.floor(F.col("vec_id") / 50).alias("id"), (F.col("vec_id") % 50).alias("pos"), F.posexplode(F.slice("embedding", 1, 20)).alias("d", "v")
    ).select("id", "pos", F.substring(F.lit(ALPHABET), F.col("d") + 1, F.lit(1)).alias("symbol"), (F.col("v").cast("double") * 10).alias("logit"))
    return me.log_softmax(logits, ["id", "pos"])


def _native(t: Tables):
    letters = F.struct("vec_id", F.substring(F.lit(ALPHABET), (F.col("vec_id") % 20 + 1).cast("int"), F.lit(1)).alias("c"))
    # fifty rows per sequence by construction
    return t.embeddings.groupBy(F.floor(F.col("vec_id") / 50).alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(letters)), lambda s: s["c"]), "").alias("sequence")
    )


@query("log_softmax", f"WITH {LOGITS} SELECT id, pos, symbol, round(log_prob,6) AS log_prob FROM lp")
def log_softmax(t: Tables):
    return _log_probs(t).select("id", "pos", "symbol", "log_prob")


@query("mean_log_likelihood", f"""WITH {LOGITS}, n AS (SELECT lp.id, lp.pos, log_prob FROM lp JOIN sq ON lp.id=sq.id AND substr(sequence, lp.pos+1, 1) = symbol)
SELECT id, round(avg(CASE WHEN pos % 7 <> 3 THEN log_prob END),6) AS mean_ll, round(exp(-avg(CASE WHEN pos % 7 <> 3 THEN log_prob END)),5) AS perplexity FROM n GROUP BY 1""")
def mean_log_likelihood(t: Tables):
    chars = F.filter(F.split("sequence", ""), lambda c: c != "")
    rows = _native(t).select("id", F.posexplode(chars).alias("pos", "symbol")).withColumn("pos", F.col("pos").cast("long"))
    lls = rows.join(_log_probs(t), ["id", "pos", "symbol"]).withColumn("mask", F.col("pos") % 7 != 3)
    return me.mean_ll(lls, ["id"], mask="mask").withColumn("perplexity", F.round("perplexity", 5))


MUT = "mu AS (SELECT id, substr(sequence, p::INT+1, 1) || (p+24) || 'W' AS mutant, p AS pos, substr(sequence, p::INT+1, 1) AS wt FROM sq, range(0, 50, 3) r(p) WHERE p < length(sequence))"


def _mutants(t: Tables):
    p = F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(3))).alias("p")
    rows = _native(t).select("id", "sequence", p).where(F.col("p") < F.length("sequence"))
    return rows.select("id", F.concat(F.substring("sequence", F.col("p") + 1, F.lit(1)), F.col("p") + 24, F.lit("W")).alias("mutant"))


@query("variant_scores", f"WITH {LOGITS}, {MUT} SELECT mu.id, mutant, round(b.log_prob - a.log_prob,6) AS score FROM mu JOIN lp a ON a.id=mu.id AND a.pos=mu.pos AND a.symbol=mu.wt JOIN lp b ON b.id=mu.id AND b.pos=mu.pos AND b.symbol='W'")
def variant_scores(t: Tables):
    return me.variant_scores(_mutants(t), _log_probs(t), _native(t), offset=24).select("id", "mutant", "score")


@query("variant_ensemble", f"""WITH {LOGITS}, {MUT}, s AS (SELECT mu.id, mutant, b.log_prob - a.log_prob AS v FROM mu JOIN lp a ON a.id=mu.id AND a.pos=mu.pos AND a.symbol=mu.wt JOIN lp b ON b.id=mu.id AND b.pos=mu.pos AND b.symbol='W')
SELECT id, mutant, round(v,6) AS model_a, round(v*2,6) AS model_b FROM s""")
def variant_ensemble(t: Tables):
    models = F.explode(F.array(F.struct(F.lit("model_a").alias("model"), F.lit(1.0).alias("f")), F.struct(F.lit("model_b").alias("model"), F.lit(2.0).alias("f"))))
    lp = _log_probs(t).withColumn("m", models).select("id", "pos", "symbol", F.col("m.model").alias("model"), (F.col("log_prob") * F.col("m.f")).alias("log_prob"))
    scores = me.variant_scores(_mutants(t), lp, _native(t), offset=24, extra=["model"])
    return me.ensemble_columns(scores, ["id", "mutant"], ["model_a", "model_b"])


@query("pseudo_likelihood", f"WITH {LOGITS} SELECT lp.id, round(sum(log_prob),5) AS pseudo_ll FROM lp JOIN sq ON lp.id=sq.id AND substr(sequence, lp.pos+1, 1) = symbol WHERE lp.pos BETWEEN 1 AND length(sequence)-2 GROUP BY 1")
def pseudo_likelihood(t: Tables):
    return me.pseudo_likelihood(_native(t), _log_probs(t)).withColumn("pseudo_ll", F.round("pseudo_ll", 5))


# ------------------------------------------------------------------- contact maps
MAP = """mp AS (SELECT vec_id // 50 AS id, vec_id % 50 AS i, d AS j, embedding[d+1]::DOUBLE AS value FROM embeddings, range(50) r(d))"""


def _map(t: Tables):
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 50).alias("id"), (F.col("vec_id") % 50).alias("i"), F.posexplode(F.slice("embedding", 1, 50)).alias("j", "v")
    ).select("id", "i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("value"))


@query("symmetrize", f"WITH {MAP} SELECT id, i, j, round(sum(value),6) AS value FROM (SELECT id, i, j, value FROM mp UNION ALL SELECT id, j, i, value FROM mp) GROUP BY 1,2,3")
def symmetrize(t: Tables):
    return st.symmetrize(_map(t), ["id"])


@query("average_product_correction", f"""WITH {MAP}, q AS (SELECT id, i, j, value + 1 AS value FROM mp), r AS (SELECT id, i, sum(value) AS r FROM q GROUP BY 1,2), c AS (SELECT id, j, sum(value) AS c FROM q GROUP BY 1,2), t AS (SELECT id, sum(value) AS t FROM q GROUP BY 1)
SELECT q.id, q.i, q.j, round(value - r*c/t,6) AS value FROM q JOIN r ON q.id=r.id AND q.i=r.i JOIN c ON q.id=c.id AND q.j=c.j JOIN t ON q.id=t.id""")
def average_product_correction(t: Tables):
    return st.apc(_map(t).withColumn("value", F.col("value") + 1), ["id"])


@query("contact_precision", f"""WITH {MAP}, g AS (SELECT 'local' AS contact_range, 3 AS lo, 6 AS hi UNION ALL SELECT 'short', 6, 12 UNION ALL SELECT 'medium', 12, 24 UNION ALL SELECT 'long', 24, 2147483647),
p AS (SELECT id, contact_range, i, j, value AS score, ((i*7+j*3+id) % 4 = 0)::INT AS target FROM mp, g WHERE j-i >= lo AND j-i < hi AND (i+j) % 17 <> 5),
k AS (SELECT *, row_number() OVER (PARTITION BY id, contact_range ORDER BY -score, i, j) AS at_ FROM p), f AS (SELECT *, 50 AS length FROM k WHERE at_ <= 50),
h AS (SELECT id, contact_range, {", ".join(f"sum(CASE WHEN at_ <= floor({b}*length/10) THEN target ELSE 0 END)/floor({b}*50/10.0) AS p{b}" for b in range(1, 11))} FROM f GROUP BY 1,2)
SELECT id, contact_range, round(({"+".join(f"p{b}" for b in range(1, 11))})/10,6) AS auc, round(p10,6) AS p_at_l, round(p5,6) AS p_at_l2, round(p2,6) AS p_at_l5 FROM h""")
def contact_precision(t: Tables):
    target = F.when((F.col("i") + F.col("j")) % 17 == 5, -1).when((F.col("i") * 7 + F.col("j") * 3 + F.col("id")) % 4 == 0, 1).otherwise(0)
    pred = _map(t).where("i < j").select("id", "i", "j", F.col("value").alias("score"), target.alias("target"))
    lengths = t.embeddings.select(F.floor(F.col("vec_id") / 50).alias("id")).distinct().withColumn("length", F.lit(50))
    return st.contact_precision(pred, lengths, ["id"])


# ------------------------------------------------------------------- embeddings
def _tokens(t: Tables):
    return t.embeddings.select(F.floor(F.col("vec_id") / 50).alias("label"), (F.col("label") % 2).alias("layer"), (F.col("vec_id") % 50).alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))


@query("mean_embeddings", """WITH e AS (SELECT vec_id // 50 AS label, label % 2 AS layer, vec_id % 50 AS pos, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, layer, d::INTEGER AS d, round(avg(v),6) AS v FROM e WHERE pos >= 1 GROUP BY 1,2,3""")
def mean_embeddings(t: Tables):
    return me.pool_embeddings(_tokens(t)).select("label", "layer", F.posexplode("vec").alias("d", "v"))


@query("begin_embeddings", "SELECT vec_id // 50 AS label, label % 2 AS layer, round(embedding[1]::DOUBLE,6) AS first, round(embedding[64]::DOUBLE,6) AS last FROM embeddings WHERE vec_id % 50 = 0")
def begin_embeddings(t: Tables):
    out = me.pool_embeddings(_tokens(t), include="bos")
    return out.select("label", "layer", F.col("vec")[0].alias("first"), F.col("vec")[63].alias("last"))


@query("token_embeddings_truncated", "SELECT vec_id // 50 AS label, label % 2 AS layer, vec_id % 50 AS pos, round(embedding[1]::DOUBLE,6) AS first FROM embeddings WHERE vec_id % 50 BETWEEN 1 AND 30")
def token_embeddings_truncated(t: Tables):
    out = me.pool_embeddings(_tokens(t), include="per_tok", truncate=30)
    return out.select("label", "layer", "pos", F.col("vec")[0].alias("first"))


ATT = """r AS (SELECT vec_id // 50 AS complex_id, 0 AS chain_idx, vec_id % 50 AS pos FROM embeddings WHERE NOT (vec_id // 50 % 3 = 1 AND vec_id % 50 = 7)), e AS (SELECT vec_id // 50 AS complex_id, 0 AS chain_idx, vec_id % 50 AS pos, embedding[1]::DOUBLE AS v FROM embeddings)"""


def _attached(t: Tables):
    base = t.embeddings.select(F.floor(F.col("vec_id") / 50).alias("complex_id"), F.lit(0).alias("chain_idx"), (F.col("vec_id") % 50).alias("pos"), F.col("embedding")[0].cast("double").alias("v"))
    residues = base.where("NOT (complex_id % 3 = 1 AND pos = 7)").drop("v")
    return tb.attach_embeddings(residues, base)


@query("attach_embeddings", f"WITH {ATT} SELECT r.complex_id, r.pos, round(v,6) AS v FROM r JOIN e USING (complex_id, chain_idx, pos) WHERE r.complex_id % 3 <> 1")
def attach_embeddings(t: Tables):
    return _attached(t)[0].select("complex_id", "pos", "v")


@query("rejected_complexes", f"WITH {ATT} SELECT a.complex_id, a.n AS n_residues, b.n AS n_vectors FROM (SELECT complex_id, count(*) AS n FROM r GROUP BY 1) a JOIN (SELECT complex_id, count(*) AS n FROM e GROUP BY 1) b USING (complex_id) WHERE a.n <> b.n")
def rejected_complexes(t: Tables):
    return _attached(t)[1]


# ------------------------------------------------------------------- user functions
def _score(pdf):
    key, no, price = (pdf[c].to_numpy() for c in ("o_orderkey", "sample_no", "o_totalprice"))
    return pd.DataFrame({"o_orderkey": key, "sample_no": no, "lddt": (key % 97) / 97.0, "affinity": price / 10000.0 + no})


@query("score_complexes", "SELECT o_orderkey, s::INTEGER AS sample_no, round((o_orderkey % 97)/97.0::DOUBLE,6) AS lddt, round(o_totalprice/10000+s,6) AS affinity FROM orders, range(1,4) r(s)")
def score_complexes(t: Tables):
    return rt.score_complexes(t.dealt(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey"), _score, "o_orderkey long, sample_no int, lddt double, affinity double", samples=3)


def _fragile(row):
    if row["o_orderkey"] % 7 == 3:
        raise ValueError("bad complex")
    return {"value": row["o_totalprice"] / 1000.0}


@query("robust_map", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'failed' ELSE 'ok' END AS status, round(CASE WHEN o_orderkey % 7 = 3 THEN -1 ELSE o_totalprice/1000 END,6) AS value FROM orders")
def robust_map(t: Tables):
    out = rt.robust_map(t.orders.select("o_orderkey", "o_totalprice"), _fragile, "value double", timeout_s=30)
    return out.select("o_orderkey", "status", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("fasta_rows_table_function", "SELECT item_id, (i-1)::INTEGER AS rec_idx, 'r' || i AS label, regexp_replace(text, '\\s', '', 'g') AS sequence FROM (SELECT item_id, text, unnest([1,2]) AS i FROM benchmark)")
def fasta_rows_table_function(t: Tables):
    rt.register_table_functions(t.spark)
    body = F.regexp_replace("text", r"\s", "")
    fasta = F.concat(F.lit(">r1\n"), body, F.lit("\n>r2\n"), body)
    return t.benchmark.select("item_id", fasta.alias("body")).lateralJoin(rt.FastaRows(F.col("body").outer())).drop("body")


@query("alignment_rows_table_function", """WITH a AS (SELECT c_custkey, generate_subscripts(string_split(c_name, ''), 1)-1 AS col, unnest(string_split(c_name, '')) AS ch FROM customer), b AS (SELECT c_custkey, col, ch AS ref_char, CASE WHEN ch = '0' THEN '-' ELSE ch END AS mod_char FROM a)
SELECT c_custkey, count(*) AS columns, count(CASE WHEN mod_char <> '-' THEN 1 END) AS kept FROM b GROUP BY 1""")
def alignment_rows_table_function(t: Tables):
    rows = t.customer.select("c_custkey", F.col("c_name").alias("r"), F.replace("c_name", F.lit("0"), F.lit("-")).alias("m"))
    out = rows.lateralJoin(rt.AlignmentRows(F.col("r").outer(), F.col("m").outer()))
    return out.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("columns"), F.count("mod_idx").alias("kept"))


# ------------------------------------------------------------------- streams
def _run_folder(t: Tables, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid4().hex}"


@query("stream_meter", "SELECT strftime(ts, '%Y-%m-%d') AS window_start, round_even((value % 10)/10*9, 0)::INTEGER AS bin, round(avg(value),6) AS value, count(*) AS n FROM events GROUP BY 1,2")
def stream_meter(t: Tables):
    """Windowed meter over the event files as a stream, run to the end of the input."""
    folder = _run_folder(t, "meter")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events*.parquet").withColumn("t", F.col("value") % 10 / 10)
    out = inc.stream_meter(stream, ["value"])
    run = (
        out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch_id={i}")).start()
    )
    run.awaitTermination()
    # a window counts as last updated; state of windows behind the watermark is dropped
    done = t.spark.read.parquet(f"{folder}/out").groupBy("window_start", "bin").agg(F.max_by(F.struct("value", "n"), "batch_id").alias("r"))
    done = done.select("window_start", "bin", "r.value", "r.n")
    return done.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("incremental_processing", "SELECT o_orderkey AS name, round(o_totalprice*2,2) AS doubled FROM orders")
def incremental_processing(t: Tables):
    folder = _run_folder(t, "incremental")
    stream = t.spark.readStream.schema(t.orders.schema).parquet(f"{t.dir}/orders*.parquet").withColumnRenamed("o_orderkey", "name")

    def double(df):
        return df.select("name", (F.col("o_totalprice") * 2).alias("doubled"))

    inc.process_incremental(stream, double, f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("name", F.round("doubled", 2).alias("doubled"))


@query("stream_merge", "SELECT substr(o_orderpriority, 1, 1) AS batch, o_orderkey AS row_idx, o_totalprice AS affinity_pred, o_custkey FROM orders")
def stream_merge(t: Tables):
    """Prediction files of screening batches read as a stream and joined to the batch inputs."""
    folder = _run_folder(t, "landing")
    rows = t.orders.select(F.substring("o_orderpriority", 1, 1).alias("batch"), F.concat(F.lit("idx_"), "o_orderkey").alias("name"), F.col("o_totalprice").alias("affinity"))
    write_screening_batches(rows, folder)
    inputs = t.orders.select(F.substring("o_orderpriority", 1, 1).alias("batch"), F.col("o_orderkey").alias("row_idx"), "o_custkey")
    merged = inc.stream_merge(inc.stream_predictions(t.spark, folder), inputs)
    run = merged.writeStream.option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).format("parquet").option("path", f"{folder}-out").start()
    run.awaitTermination()
    return t.spark.read.parquet(f"{folder}-out")
