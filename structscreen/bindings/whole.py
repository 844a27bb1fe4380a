"""The same operators over whole embedding rows: every entry of a vector, every position, every target letter.

The queries of the same names without ``_whole`` take fixed parts of a vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscreen.bindings import points as pt
from structscreen.bindings.core import POINTS, REGISTRY, Tables, query
from structscreen.bindings.predictions import ALPHABET
from structscreen.operators import metrics as me
from structscreen.operators import structure as st

# --------------------------------------------------------------------- points: seven blocks of nine entries; the last entry moves the model of the last block
POINTS_WHOLE = """pts AS (
  SELECT vec_id // 50 AS cid, vec_id * 7 + b AS idx, label AS chain,
         embedding[9*b+1]::DOUBLE*20 AS x, embedding[9*b+2]::DOUBLE*20 AS y, embedding[9*b+3]::DOUBLE*20 AS z,
         embedding[9*b+4]::DOUBLE*20 AS lx, embedding[9*b+5]::DOUBLE*20 AS ly, embedding[9*b+6]::DOUBLE*20 AS lz,
         embedding[9*b+1]::DOUBLE*20+embedding[9*b+7]::DOUBLE+(CASE WHEN b=6 THEN embedding[64]::DOUBLE ELSE 0 END) AS mx, embedding[9*b+2]::DOUBLE*20+embedding[9*b+8]::DOUBLE AS my,
         embedding[9*b+3]::DOUBLE*20+embedding[9*b+9]::DOUBLE AS mz
  FROM embeddings, range(7) blocks(b))"""


class WholeTables(Tables):
    """Complexes of 350 points: seven from each vector."""

    def points(self) -> DataFrame:
        blocks = self.embeddings.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("b"))
        e = [F.get("embedding", F.col("b") * 9 + i).cast("double") for i in range(9)]
        xyz = [e[i] * 20 for i in range(6)]
        rest = F.when(F.col("b") == 6, F.col("embedding")[63].cast("double")).otherwise(0.0)
        moved = [xyz[0] + e[6] + rest, xyz[1] + e[7], xyz[2] + e[8]]
        return blocks.select(
            F.floor(F.col("vec_id") / 50).alias("cid"), (F.col("vec_id") * 7 + F.col("b")).alias("idx"), F.col("label").alias("chain"),
            *[xyz[i].alias(c) for i, c in enumerate("xyz")], *[xyz[3 + i].alias("l" + c) for i, c in enumerate("xyz")], *[moved[i].alias("m" + c) for i, c in enumerate("xyz")],
        )


OVER_POINTS = (
    "radius_join", "radius_graph_directed", "scaled_radius_join", "neighbor_graph_capped", "nearest_neighbors", "nearest_chain", "pocket_atoms_near_ligand",
    "pocket_around_centroid", "clash_score", "lddt_with_binding_site", "lddt_per_residue", "lddt_symmetry_choice", "cross_lddt", "bond_violations", "neighbor_anisotropy",
    "scatter_edges_to_nodes", "coordinate_rmsd", "protein_and_pocket_rmsd", "centered_coordinates", "distance_features", "unit_vectors",
)
for _name in OVER_POINTS:
    _sql = REGISTRY[_name].sql
    assert POINTS in _sql, _name
    query(f"{_name}_whole", _sql.replace(POINTS, POINTS_WHOLE))(lambda t, fn=getattr(pt, _name): fn(WholeTables(t.spark, t.dir)))

# --------------------------------------------------------------------- likelihoods: three blocks of twenty letters and one of four per vector
LOGITS = f"""lg AS (SELECT vec_id // 50 AS id, (vec_id % 50) * 4 + d // 20 AS pos, substr('{ALPHABET}', d::INT % 20 + 1, 1) AS symbol, embedding[d+1]::DOUBLE*10 AS logit FROM embeddings, range(64) r(d)),
lp AS (SELECT id, pos, symbol, logit - mx - ln(sum(exp(logit - mx)) OVER (PARTITION BY id, pos)) AS log_prob FROM (SELECT *, max(logit) OVER (PARTITION BY id, pos) AS mx FROM lg)),
sq AS (SELECT vec_id // 50 AS id, string_agg(substr('{ALPHABET}', CASE WHEN b < 3 THEN (vec_id + 7 * b)::INT % 20 ELSE vec_id::INT % 4 END + 1, 1), '' ORDER BY vec_id, b) AS sequence
  FROM embeddings, range(4) r(b) GROUP BY 1),
mu AS (SELECT sq.id, lp.pos, symbol AS target, substr(sequence, lp.pos::INT + 1, 1) AS wt, substr(sequence, lp.pos::INT + 1, 1) || (lp.pos + 24) || symbol AS mutant
  FROM sq JOIN lp ON lp.id = sq.id WHERE substr(sequence, lp.pos::INT + 1, 1) <> symbol),
sc AS (SELECT mu.id, mutant, b.log_prob - a.log_prob AS score FROM mu JOIN lp a ON a.id=mu.id AND a.pos=mu.pos AND a.symbol=mu.wt JOIN lp b ON b.id=mu.id AND b.pos=mu.pos AND b.symbol=mu.target)"""


def _symbols(t: Tables) -> DataFrame:
    entries = t.embeddings.select("vec_id", F.posexplode("embedding").alias("d", "v"))
    pos = (F.col("vec_id") % 50) * 4 + F.floor(F.col("d") / 20)
    symbol = F.substring(F.lit(ALPHABET), (F.col("d") % 20 + 1).cast("int"), F.lit(1))
    return entries.select(F.floor(F.col("vec_id") / 50).alias("id"), pos.alias("pos"), symbol.alias("symbol"), (F.col("v").cast("double") * 10).alias("logit"))


def _log_probs(t: Tables) -> DataFrame:
    return me.log_softmax(_symbols(t), ["id", "pos"])


def _native(t: Tables) -> DataFrame:
    b = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b")
    letter = F.when(F.col("b") < 3, (F.col("vec_id") + 7 * F.col("b")) % 20).otherwise(F.col("vec_id") % 4)
    letters = F.struct("vec_id", "b", F.substring(F.lit(ALPHABET), (letter + 1).cast("int"), F.lit(1)).alias("c"))
    # two hundred letters per sequence by construction
    return t.embeddings.select("vec_id", b).groupBy(F.floor(F.col("vec_id") / 50).alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(letters)), lambda s: s["c"]), "").alias("sequence")
    )


def _mutants(t: Tables) -> DataFrame:
    at = _symbols(t).select("id", "pos", "symbol").join(_native(t), "id")
    wild = F.substring("sequence", (F.col("pos") + 1).cast("int"), F.lit(1))
    return at.where(wild != F.col("symbol")).select("id", F.concat(wild, (F.col("pos") + 24).cast("string"), "symbol").alias("mutant"))


@query("log_softmax_whole", f"WITH {LOGITS} SELECT id, pos, symbol, round(log_prob,6) AS log_prob FROM lp")
def log_softmax_whole(t: Tables):
    return _log_probs(t).select("id", "pos", "symbol", "log_prob")


@query("mean_log_likelihood_whole", f"""WITH {LOGITS}, n AS (SELECT lp.id, lp.pos, log_prob FROM lp JOIN sq ON lp.id=sq.id AND substr(sequence, lp.pos::INT+1, 1) = symbol)
SELECT id, round(avg(log_prob),6) AS mean_ll, round(exp(-avg(log_prob)),5) AS perplexity FROM n GROUP BY 1""")
def mean_log_likelihood_whole(t: Tables):
    chars = F.filter(F.split("sequence", ""), lambda c: c != "")
    rows = _native(t).select("id", F.posexplode(chars).alias("pos", "symbol")).withColumn("pos", F.col("pos").cast("long"))
    return me.mean_ll(rows.join(_log_probs(t), ["id", "pos", "symbol"]), ["id"]).withColumn("perplexity", F.round("perplexity", 5))


@query("variant_scores_whole", f"WITH {LOGITS} SELECT id, mutant, round(score,6) AS score FROM sc")
def variant_scores_whole(t: Tables):
    return me.variant_scores(_mutants(t), _log_probs(t), _native(t), offset=24).select("id", "mutant", "score")


@query("variant_ensemble_whole", f"WITH {LOGITS} SELECT id, mutant, round(score,6) AS model_a, round(score*2,6) AS model_b FROM sc")
def variant_ensemble_whole(t: Tables):
    models = F.explode(F.array(F.struct(F.lit("model_a").alias("model"), F.lit(1.0).alias("f")), F.struct(F.lit("model_b").alias("model"), F.lit(2.0).alias("f"))))
    lp = _log_probs(t).withColumn("m", models).select("id", "pos", "symbol", F.col("m.model").alias("model"), (F.col("log_prob") * F.col("m.f")).alias("log_prob"))
    scores = me.variant_scores(_mutants(t), lp, _native(t), offset=24, extra=["model"])
    return me.ensemble_columns(scores, ["id", "mutant"], ["model_a", "model_b"])


@query("pseudo_likelihood_whole", f"WITH {LOGITS} SELECT lp.id, round(sum(log_prob),4) AS pseudo_ll FROM lp JOIN sq ON lp.id=sq.id AND substr(sequence, lp.pos::INT+1, 1) = symbol WHERE lp.pos BETWEEN 1 AND length(sequence)-2 GROUP BY 1")
def pseudo_likelihood_whole(t: Tables):
    return me.pseudo_likelihood(_native(t), _log_probs(t)).withColumn("pseudo_ll", F.round("pseudo_ll", 4))


# --------------------------------------------------------------------- maps of 64 by 64
MAP = "mp AS (SELECT vec_id // 64 AS id, vec_id % 64 AS i, d AS j, embedding[d+1]::DOUBLE AS value FROM embeddings, range(64) r(d))"


def _map(t: Tables) -> DataFrame:
    entries = t.embeddings.select(F.floor(F.col("vec_id") / 64).alias("id"), (F.col("vec_id") % 64).alias("i"), F.posexplode("embedding").alias("j", "v"))
    return entries.select("id", "i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("value"))


@query("symmetrize_whole", f"WITH {MAP} SELECT id, i, j, round(sum(value),6) AS value FROM (SELECT id, i, j, value FROM mp UNION ALL SELECT id, j, i, value FROM mp) GROUP BY 1,2,3")
def symmetrize_whole(t: Tables):
    return st.symmetrize(_map(t), ["id"])


@query("average_product_correction_whole", f"""WITH {MAP}, q AS (SELECT id, i, j, value + 1 AS value FROM mp), r AS (SELECT id, i, sum(value) AS r FROM q GROUP BY 1,2),
c AS (SELECT id, j, sum(value) AS c FROM q GROUP BY 1,2), t AS (SELECT id, sum(value) AS t FROM q GROUP BY 1)
SELECT q.id, q.i, q.j, round(value - r*c/t,6) AS value FROM q JOIN r ON q.id=r.id AND q.i=r.i JOIN c ON q.id=c.id AND q.j=c.j JOIN t ON q.id=t.id""")
def average_product_correction_whole(t: Tables):
    return st.apc(_map(t).withColumn("value", F.col("value") + 1), ["id"])


@query("contact_precision_whole", f"""WITH {MAP}, g AS (SELECT 'local' AS contact_range, 3 AS lo, 6 AS hi UNION ALL SELECT 'short', 6, 12 UNION ALL SELECT 'medium', 12, 24 UNION ALL SELECT 'long', 24, 2147483647),
p AS (SELECT id, contact_range, i, j, value AS score, ((i*7+j*3+id) % 4 = 0)::INT AS target FROM mp, g WHERE j-i >= lo AND j-i < hi AND (i+j) % 17 <> 5),
k AS (SELECT *, row_number() OVER (PARTITION BY id, contact_range ORDER BY -score, i, j) AS at_ FROM p), f AS (SELECT * FROM k WHERE at_ <= 64),
h AS (SELECT id, contact_range, {", ".join(f"sum(CASE WHEN at_ <= floor({b}*64/10.0) THEN target ELSE 0 END)/floor({b}*64/10.0) AS p{b}" for b in range(1, 11))} FROM f GROUP BY 1,2)
SELECT id, contact_range, round(({"+".join(f"p{b}" for b in range(1, 11))})/10,6) AS auc, round(p10,6) AS p_at_l, round(p5,6) AS p_at_l2, round(p2,6) AS p_at_l5 FROM h""")
def contact_precision_whole(t: Tables):
    target = F.when((F.col("i") + F.col("j")) % 17 == 5, -1).when((F.col("i") * 7 + F.col("j") * 3 + F.col("id")) % 4 == 0, 1).otherwise(0)
    pred = _map(t).where("i < j").select("id", "i", "j", F.col("value").alias("score"), target.alias("target"))
    lengths = t.embeddings.select(F.floor(F.col("vec_id") / 64).alias("id")).distinct().withColumn("length", F.lit(64))
    return st.contact_precision(pred, lengths, ["id"])
