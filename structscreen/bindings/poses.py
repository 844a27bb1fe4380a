"""Pose ranking, selection and screening queries (lineitem as a pose table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from structscreen.bindings.core import POSES, RANKED, Tables, query
from structscreen.operators import ranking as rk
from structscreen.operators import sampling as sp
from structscreen.operators import tables as tb
from structscreen.plans.skew import avg_rank

TIE = ("l_partkey", "l_suppkey", "l_linenumber")
TIE_SQL = "l_partkey, l_suppkey, l_linenumber"
# the four keys repeat once in the smallest tables; the values tell such rows apart
ROW = (*TIE, "affinity", "rmsd", "clashScore", "pocket_rmsd", "dataset_name")
GROUP = "entryName, conformation"
M = 2147483647
A = 1103515245


def draw_sql(seed: int, *keys: str) -> str:
    h = str(seed)
    for key in keys:
        h = f"((({h})::BIGINT * {A} + ({key}) % {M}) % {M})"
    return h


SCORES = {
    "by_rank_div5_plus_clash_rank": "round(rank/5.0 + clash_rank, 9)",
    "by_rank_plus_clash_rank_div2": "round(rank + clash_rank/2, 9)",
    "by_rank": "rank",
    "by_rmsd": "rmsd",
    "by_clashScore": "clashScore",
    "random": draw_sql(7, "l_partkey", "l_suppkey", "l_linenumber"),
    "rmsd_combined_rank": "round(rank + affinity_rank/3 + clash_rank, 9)",
}


def picked_sql(policy: str, no: int) -> str:
    return (
        f"SELECT {no} AS policy_no, '{policy}' AS selection, * FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP} "
        f"ORDER BY {SCORES[policy]}, {', '.join(ROW)}) AS rn FROM ranked) WHERE rn = 1"
    )


SUMMARY = """per_run AS (
  SELECT selection, conformation, avg(CASE WHEN rmsd<2 THEN 1.0 ELSE 0.0 END) AS below2A,
         avg(CASE WHEN rmsd<5 THEN 1.0 ELSE 0.0 END) AS below5A, avg(pocket_rmsd) AS pocket_rmsd, count(*) AS n_entries
  FROM chosen GROUP BY 1,2),
per_set AS (SELECT policy_no, selection, conformation, dataset_name, avg(clashScore) AS clashScore FROM chosen GROUP BY 1,2,3,4)
SELECT {no} selection, conformation, dataset_name, round(clashScore,6) AS clashScore, round(below2A,6) AS below2A,
       round(below5A,6) AS below5A, round(pocket_rmsd,6) AS pocket_rmsd, n_entries
FROM per_set JOIN per_run USING (selection, conformation)"""


@query("all_policies_report", f"WITH {RANKED}, chosen AS ("
       + " UNION ALL ".join(picked_sql(p, i) for i, p in enumerate(rk.POLICIES)) + "), " + SUMMARY.format(no="policy_no,"))
def all_policies_report(t: Tables):
    return rk.show_all_metrics(t.poses(), tie=ROW, draw_keys=TIE)


@query("run_summary_combined_policy", f"WITH {RANKED}, chosen AS ({picked_sql('rmsd_combined_rank', 0)}), " + SUMMARY.format(no=""))
def run_summary_combined_policy(t: Tables):
    chosen = rk.select_poses(t.poses(), "rmsd_combined_rank", tie=ROW, draw_keys=TIE)
    return rk.summarize(chosen, ["selection"])


@query("average_ranks", f"WITH {RANKED} SELECT {GROUP}, {TIE_SQL}, clash_rank, affinity_rank FROM ranked")
def average_ranks(t: Tables):
    return rk.with_ranks(t.poses()).select("entryName", "conformation", *TIE, "clash_rank", "affinity_rank")


def _selection(policy: str):
    sql = f"WITH {RANKED}, chosen AS ({picked_sql(policy, 0)}) SELECT {GROUP}, {TIE_SQL}, round(affinity,6) AS affinity FROM chosen"

    @query(f"select_{policy}", sql)
    def run(t: Tables):
        return rk.select_poses(t.poses(), policy, tie=ROW, draw_keys=TIE).select("entryName", "conformation", *TIE, "affinity")


for _p in rk.POLICIES:
    _selection(_p)


@query("weighted_affinity", f"WITH {POSES} SELECT entryName, round(least(sum(affinity*lddt)/(sum(lddt)+1e-12), 15), 6) AS affinity FROM poses GROUP BY 1")
def weighted_affinity(t: Tables):
    return rk.weighted_affinity(t.poses(), ["entryName"])


@query("fraction_below", f"""WITH {POSES} SELECT conformation, round(avg(CASE WHEN rmsd<2 THEN 1.0 ELSE 0.0 END),6) AS below2A,
  round(avg(CASE WHEN rmsd<5 THEN 1.0 ELSE 0.0 END),6) AS below5A FROM poses GROUP BY 1""")
def fraction_below(t: Tables):
    return t.poses().groupBy("conformation").agg(rk.frac_below("rmsd", 2).alias("below2A"), rk.frac_below("rmsd", 5).alias("below5A"))


@query("value_counts", "SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders")
def value_counts(t: Tables):
    return rk.value_counts(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("final_rerank", f"""WITH {POSES}, r AS (SELECT *,
  rank() OVER (PARTITION BY entryName ORDER BY lddt DESC) + (count(*) OVER (PARTITION BY entryName, lddt)-1)/2.0 AS s,
  rank() OVER (PARTITION BY entryName ORDER BY clashScore) + (count(*) OVER (PARTITION BY entryName, clashScore)-1)/2.0 AS c FROM poses)
SELECT entryName, conformation, {TIE_SQL}, row_number() OVER (PARTITION BY entryName ORDER BY round(s+c/2,9), conformation, {TIE_SQL}) AS final_rank FROM r""")
def final_rerank(t: Tables):
    return rk.rerank(t.poses(), ["entryName"], tie=("conformation", *TIE)).select("entryName", "conformation", *TIE, "final_rank")


@query("compact_ranks", f"""WITH {POSES}, ok AS (SELECT * FROM poses WHERE NOT (rmsd > 5 OR pocket_rmsd > 6 OR affinity > 9))
SELECT entryName, conformation, {TIE_SQL}, rank, row_number() OVER (PARTITION BY entryName ORDER BY rank, conformation, {TIE_SQL}) AS new_rank FROM ok""")
def compact_ranks(t: Tables):
    flagged = rk.accept_poses(t.poses().withColumns({
        "protein_violations": (F.col("rmsd") > 5).cast("int"), "ligand_violations": (F.col("pocket_rmsd") > 6).cast("int"),
    }), energy="affinity", limit=9)
    ok = rk.compact_ranks(flagged.where("accepted"), ["entryName"], tie=("conformation", *TIE))
    return ok.select("entryName", "conformation", *TIE, "rank", "new_rank")


@query("accept_poses", f"""WITH {POSES} SELECT conformation, NOT (rmsd > 5 OR pocket_rmsd > 6 OR affinity > 9) AS accepted, count(*) AS n FROM poses GROUP BY 1, 2""")
def accept_poses(t: Tables):
    flagged = rk.accept_poses(t.poses().withColumns({
        "protein_violations": (F.col("rmsd") > 5).cast("int"), "ligand_violations": (F.col("pocket_rmsd") > 6).cast("int"),
    }), energy="affinity", limit=9)
    return flagged.groupBy("conformation", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("top_poses", f"""WITH {POSES} SELECT entryName, conformation, {TIE_SQL}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY rank, l_partkey, l_suppkey) AS rn FROM poses) WHERE rn <= 3""")
def top_poses(t: Tables):
    return rk.top_poses(t.poses(), 3, order=("rank", "l_partkey", "l_suppkey")).select("entryName", "conformation", *TIE, "rank")


@query("sample_one_per_group", f"""WITH {POSES} SELECT {GROUP}, {TIE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY {draw_sql(11, 'l_partkey', 'l_suppkey', 'l_linenumber')}, {TIE_SQL}) AS rn FROM poses) WHERE rn = 1""")
def sample_one_per_group(t: Tables):
    poses = t.poses().select("entryName", "conformation", *TIE)
    return rk.sample_one(poses, ["entryName", "conformation"], keys=TIE, seed=11)


@query("failure_report", f"""WITH {POSES} SELECT conformation, CASE WHEN rmsd > 5 THEN 'failed' WHEN pocket_rmsd > 6 THEN 'skipped' ELSE 'succeeded' END AS status, count(*) AS n FROM poses GROUP BY 1,2""")
def failure_report(t: Tables):
    status = F.when(F.col("rmsd") > 5, "failed").when(F.col("pocket_rmsd") > 6, "skipped").otherwise("succeeded")
    return rk.failure_report(t.poses().withColumn("status", status), by=["conformation"])


# ---------------------------------------------------------------------- screening batches
BATCH = """inp AS (SELECT o_orderpriority AS batch, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS row_idx,
  'idx_' || (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) AS name, o_orderkey FROM orders),
agg AS (SELECT l_orderkey, sum(l_extendedprice)/10000 AS affinity FROM lineitem GROUP BY 1),
pred AS (SELECT batch, name, affinity FROM inp JOIN agg ON o_orderkey = l_orderkey)"""


def _batches(t: Tables):
    jobs = rk.with_job_name(t.orders.select(F.col("o_orderpriority").alias("batch"), "o_orderkey"), ["o_orderkey"], ["batch"])
    agg = t.lineitem.groupBy("l_orderkey").agg((F.sum("l_extendedprice") / 10000).alias("affinity"))
    preds = jobs.join(agg, F.col("o_orderkey") == F.col("l_orderkey")).select("batch", "name", "affinity")
    return jobs, preds


@query("job_names", f"WITH {BATCH} SELECT batch, o_orderkey, row_idx, name FROM inp")
def job_names(t: Tables):
    return _batches(t)[0].select("batch", "o_orderkey", "row_idx", "name")


@query("merge_screening", f"""WITH {BATCH} SELECT i.batch, i.row_idx, i.o_orderkey, round(p.affinity,6) AS affinity_pred FROM inp i JOIN pred p
  ON i.batch = p.batch AND i.row_idx = split_part(p.name, '_', 2)::BIGINT""")
def merge_screening(t: Tables):
    jobs, preds = _batches(t)
    return rk.merge_screening(jobs.drop("name"), preds).select("batch", "row_idx", "o_orderkey", "affinity_pred")


@query("pending_jobs", f"""WITH {BATCH} SELECT batch, name FROM inp WHERE name NOT IN (SELECT name FROM pred WHERE affinity > 20) AND name IN (SELECT name FROM pred)""")
def pending_jobs(t: Tables):
    jobs, preds = _batches(t)
    return tb.pending(jobs.select("batch", "name"), preds.where("affinity > 20"), preds)


@query("lookup_enrichment", """SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def lookup_enrichment(t: Tables):
    dim = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return tb.lookup(t.orders.select("o_orderkey", "o_custkey"), dim, "o_custkey")


@query("concatenate_results", """SELECT 0 AS part_no, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier""")
def concatenate_results(t: Tables):
    a = t.customer.select(F.lit(0).alias("part_no"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return a.unionByName(t.supplier.select(F.lit(1).alias("part_no"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")))


@query("names_in_both_stores", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def names_in_both_stores(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.select(F.col("c_custkey").alias("k")))


@query("names_in_any_cache", "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def names_in_any_cache(t: Tables):
    return t.lineitem.select(F.col("l_partkey").alias("k")).union(t.part.select(F.col("p_partkey").alias("k"))).distinct()


@query("distinct_proteins", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_proteins(t: Tables):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("remove_failed_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def remove_failed_rows(t: Tables):
    failed = t.lineitem.where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return tb.purge(t.orders.select("o_orderkey", "o_totalprice"), failed, "o_orderkey")


@query("per_distinct_protein", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_size*2 AS parsed FROM lineitem JOIN part ON l_partkey = p_partkey""")
def per_distinct_protein(t: Tables):
    def parse(keys):
        return keys.join(t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 2).alias("parsed")), "l_partkey")

    return tb.per_distinct(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_partkey", parse)


# ---------------------------------------------------------------------- table utilities
@query("select_split", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice/500000 > 0.8")
def select_split(t: Tables):
    df = t.orders.withColumn("fraction", F.col("o_totalprice") / 500000)
    return tb.select_split(df, "F", 0.8, group_col="o_orderstatus", fraction="fraction").select("o_orderkey", "o_totalprice")


@query("dataset_registry", """SELECT dataset_name, count(*) AS n, count(name) AS named, round(sum(bal),2) AS bal FROM (
  SELECT 'customers' AS dataset_name, c_name AS name, c_acctbal AS bal FROM customer UNION ALL
  SELECT 'suppliers', s_name, s_acctbal FROM supplier UNION ALL SELECT 'nations', n_name, NULL FROM nation) GROUP BY 1""")
def dataset_registry(t: Tables):
    dfs = {
        "customers": t.customer.withColumnRenamed("c_acctbal", "bal"), "suppliers": t.supplier.withColumnRenamed("s_acctbal", "bal"), "nations": t.nation,
    }
    alias = {"customers": {"name": "c_name"}, "suppliers": {"name": "s_name"}, "nations": {"name": "n_name"}}
    out = tb.dataset_registry(dfs, alias).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.sum("bal").alias("bal"))
    return out.withColumn("bal", F.round("bal", 2))


@query("decode_run_names", """WITH r AS (SELECT o_orderkey, o_orderstatus AS head, CASE o_orderkey % 4 WHEN 0 THEN 'test_crystal' WHEN 1 THEN 'test_kinase'
  WHEN 2 THEN 'test_af2_v9_0419' ELSE 'own_set' END AS tail FROM orders)
SELECT o_orderkey, head || CASE tail WHEN 'test_crystal' THEN '_crystal' WHEN 'test_af2_v9_0419' THEN '_0419' ELSE '' END AS header,
  CASE tail WHEN 'test_crystal' THEN 'pdbbind_v9' WHEN 'test_kinase' THEN 'kinase' WHEN 'test_af2_v9_0419' THEN 'pdbbind_v9' ELSE tail END AS dataset_name FROM r""")
def decode_run_names(t: Tables):
    k = F.col("o_orderkey") % 4
    tail = F.when(k == 0, "test_crystal").when(k == 1, "test_kinase").when(k == 2, "test_af2_v9_0419").otherwise("own_set")
    df = t.orders.select("o_orderkey", F.concat_ws("__", "o_orderstatus", tail).alias("run"))
    return tb.decode_run_name(df, "run").drop("run")


@query("column_defaults_and_order", "SELECT s_name AS name, s_suppkey, s_nationkey, s_acctbal, s_name AS crystal, 'A' AS chain FROM supplier")
def column_defaults_and_order(t: Tables):
    df = tb.with_defaults(t.supplier, {"crystal": "s_name", "chain": F.lit("A"), "s_acctbal": F.lit(0.0)})
    return tb.cols_to_end(tb.cols_to_front(df.withColumnRenamed("s_name", "name"), ["name"]), ["crystal", "chain"])


@query("quality_filter", "SELECT p_partkey AS id, p_size/50 AS ptm, round((p_retailprice-900)/100, 6) AS plddt FROM part WHERE p_size/50 > 0.7 AND (p_retailprice-900)/100 > 0.7")
def quality_filter(t: Tables):
    return tb.high_quality(_stats(t)).select("id", "ptm", "plddt")


@query("design_flags", "SELECT l_suppkey, l_tax > 0.05 AS soluble, count(*) AS n FROM lineitem GROUP BY 1, 2")
def design_flags(t: Tables):
    return tb.design_flags(t.lineitem, "l_tax").groupBy("l_suppkey", "soluble").agg(F.count(F.lit(1)).alias("n"))


def _stats(t: Tables):
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"), (F.col("p_size") / 50).alias("ptm"),
        ((F.col("p_retailprice") - 900) / 100).alias("plddt"), F.col("p_size").alias("len"),
    )


STATS = "st AS (SELECT p_partkey AS id, p_brand AS cluster, p_size/50 AS ptm, (p_retailprice-900)/100 AS plddt, p_size AS len FROM part)"


@query("cluster_representatives", f"""WITH {STATS} SELECT cluster, id, round(ptm,6) AS ptm, round(plddt,6) AS plddt, len FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY -(ptm*plddt), id) AS rn FROM st) WHERE rn = 1""")
def cluster_representatives(t: Tables):
    return tb.cluster_representatives(_stats(t))


@query("quality_bins", f"""WITH {STATS} SELECT floor(round(ptm*10,9))::BIGINT AS ptm_bin, floor(round(plddt*10,9))::BIGINT AS plddt_bin, count(*) AS n, sum(len)::BIGINT AS total_len FROM st GROUP BY 1,2""")
def quality_bins(t: Tables):
    return tb.quality_bins(_stats(t))


@query("hit_summary", """WITH h AS (SELECT l_suppkey AS design_id, l_extendedprice/50000 AS evalue, l_discount AS identity, l_tax AS tm_score, l_orderkey, l_partkey, l_linenumber FROM lineitem),
top AS (SELECT design_id, max(tm_score) AS m FROM (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY evalue, l_orderkey, l_partkey, l_linenumber) AS rn FROM h) WHERE rn <= 10 GROUP BY 1)
SELECT h.design_id, round(min(evalue),6) AS min_evalue, max(CASE WHEN evalue < 1 THEN identity END) AS max_identity, max(m) AS max_tm_top FROM h JOIN top USING (design_id) GROUP BY 1""")
def hit_summary(t: Tables):
    hits = t.lineitem.select(
        F.col("l_suppkey").alias("design_id"), (F.col("l_extendedprice") / 50000).alias("evalue"), F.col("l_discount").alias("identity"),
        F.col("l_tax").alias("tm_score"), "l_orderkey", "l_partkey", "l_linenumber",
    )
    return tb.hit_summary(hits, tie=("l_orderkey", "l_partkey", "l_linenumber"))


@query("normalized_similarity", """WITH p AS (SELECT l_suppkey AS query, l_partkey AS target, sum(l_quantity) AS score FROM lineitem GROUP BY 1,2),
q AS (SELECT s_suppkey AS query, abs(s_acctbal)+1 AS score FROM supplier), g AS (SELECT p_partkey AS target, p_retailprice AS score FROM part)
SELECT p.query, p.target, round(p.score/sqrt(q.score*g.score),6) AS similarity FROM p JOIN q USING (query) JOIN g USING (target)""")
def normalized_similarity(t: Tables):
    pair = t.lineitem.groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("target")).agg(F.sum("l_quantity").alias("score"))
    q = t.supplier.select(F.col("s_suppkey").alias("query"), (F.abs("s_acctbal") + 1).alias("score"))
    g = t.part.select(F.col("p_partkey").alias("target"), F.col("p_retailprice").alias("score"))
    return tb.normalize_scores(pair, q, g)


@query("combine_caches", """SELECT o_orderkey, o_custkey, array_to_string([o_totalprice::DOUBLE, o_custkey::DOUBLE, o_totalprice::DOUBLE], '|') AS vals FROM orders""")
def combine_caches(t: Tables):
    keys = ("o_orderkey", "o_custkey")
    name = F.concat_ws("_", *keys)
    price = F.col("o_totalprice").cast("double")
    first = t.orders.select(name.alias("name"), F.array(price, F.col("o_custkey").cast("double")).alias("values"))
    second = t.orders.select(name.alias("name"), F.array(price).alias("values"))
    out = tb.combine_caches([first, second])
    part = F.split("name", "_")
    return out.select(*[part[i].cast("long").alias(k) for i, k in enumerate(keys)], F.array_join(F.col("values").cast("array<string>"), "|").alias("vals"))


@query("job_fingerprint", """WITH RECURSIVE t(n, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT n, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM t WHERE k < 8),
tbl AS (SELECT list(c ORDER BY n) AS l FROM t WHERE k = 8),
txt AS (SELECT string_agg(s_name, '' ORDER BY s_suppkey) || string_agg(s_nationkey::VARCHAR, '' ORDER BY s_suppkey) AS s FROM supplier)
SELECT xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS fingerprint FROM tbl, txt""")
def job_fingerprint(t: Tables):
    jobs = rk.with_job_name(t.supplier.select("s_suppkey", F.col("s_name").alias("ligand"), F.col("s_nationkey").cast("string").alias("protein_path")), ["s_suppkey"])
    return tb.job_fingerprint(jobs)


# ---------------------------------------------------------------------- samples and splits
@query("split_80_20", f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql(3, 'doc_id')}, doc_id) AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, i <= floor(n * 0.8) AS is_train FROM d""")
def split_80_20(t: Tables):
    return sp.split_frac(t.documents.select("doc_id"), 0.8, keys=["doc_id"], seed=3)


@query("sample_without_replacement", f"SELECT doc_id FROM documents ORDER BY {draw_sql(5, 'doc_id')}, doc_id LIMIT 150")
def sample_without_replacement(t: Tables):
    return sp.sample_n(t.documents.select("doc_id"), 150, keys=["doc_id"], seed=5)


@query("structural_folds", """WITH c AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) % 5 AS part FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, part::INTEGER AS part FROM documents JOIN c USING (source)""")
def structural_folds(t: Tables):
    return sp.group_kfold(t.documents.select("doc_id", "source"), "source")


@query("balanced_sample", f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT source, row_number() OVER (ORDER BY source) AS key_no FROM (SELECT DISTINCT source FROM documents)),
d AS (SELECT range AS draw_no, {draw_sql(9, 'range')} % (SELECT count(*) FROM k) + 1 AS key_no, {draw_sql(10, 'range')} AS e FROM range((SELECT count(*) FROM documents)))
SELECT draw_no, doc_id, source FROM d JOIN k USING (key_no) JOIN r USING (source) WHERE r.i = d.e % r.n + 1""")
def balanced_sample(t: Tables):
    return sp.balanced_sample(t.documents.select("doc_id", "source"), "source", order=["doc_id"], seed=9)


@query("balanced_pick", f"""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity/8 AS rmsd, (l_quantity/8 < 2)::INTEGER AS ok FROM lineitem),
g AS (SELECT l_orderkey, sum(ok) AS s, count(*) AS n, {draw_sql(1, 'l_orderkey')} % 2 AS label, {draw_sql(2, 'l_orderkey')} AS h FROM s GROUP BY l_orderkey),
w AS (SELECT *, CASE WHEN label = 0 AND s < n THEN 0 WHEN s > 0 THEN 1 END AS want FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, ok ORDER BY l_partkey, l_suppkey, l_linenumber) AS i FROM s)
SELECT w.l_orderkey, w.label::INTEGER AS label, coalesce(r.l_partkey, -1) AS l_partkey, coalesce(r.l_suppkey, -1) AS l_suppkey, coalesce(r.l_linenumber, -1) AS l_linenumber FROM w LEFT JOIN r ON w.l_orderkey = r.l_orderkey AND w.want = r.ok
  AND r.i = w.h % (CASE WHEN want = 1 THEN s ELSE n - s END) + 1""")
def balanced_pick(t: Tables):
    df = t.lineitem.select("l_orderkey", *TIE, (F.col("l_quantity") / 8).alias("rmsd"), F.col("l_orderkey").alias("h"))
    out = sp.balanced_pick(df, "l_orderkey", order=TIE, seed=1, hash_key="h")
    return out.select("l_orderkey", "label", *TIE).na.fill(-1)


@query("purge_and_restrict", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) AND doc_id IN (SELECT doc_id FROM labels)""")
def purge_and_restrict(t: Tables):
    docs = tb.purge(t.documents.select("doc_id", "source"), t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id")
    return tb.restrict(docs, t.labels, "doc_id")


@query("head_by_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def head_by_order(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
