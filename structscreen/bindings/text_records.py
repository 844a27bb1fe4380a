"""File-format queries: records written as text from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from structscreen.bindings.core import POINTS, Tables, query
from structscreen.plans.skew import over_groups
from structscreen.sources import ligand as lg
from structscreen.sources import lines as li
from structscreen.sources import pdb
from structscreen.sources import tables as ts

NAMES = ("N", "CA", "C", "O", "CB")


def _atom_table(t: Tables):
    p = t.points()
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("idx") % 5 + 1).cast("int"))
    return p.select(
        F.col("cid").alias("structure_id"), (F.floor(F.col("idx") % 50 / 25)).cast("int").alias("model"), F.lit("ATOM").alias("record"),
        (F.col("idx") % 50).cast("int").alias("atom_number"), name.alias("atom_name"), F.lit(" ").alias("altloc"), F.lit("ALA").alias("resname"),
        F.when(F.col("chain") < 5, "A").otherwise("B").alias("chain"), F.floor(F.col("idx") % 50 / 5).cast("int").alias("resid"), F.lit(" ").alias("insertion"),
        "x", "y", "z", F.lit(1.0).alias("occupancy"), (F.col("chain") * 10.0).alias("b_factor"), F.substring(name, 1, 1).alias("element"), F.lit("").alias("charge"),
        F.col("idx").alias("line_idx"),
    )


NAME_SQL = "CASE idx % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' WHEN 3 THEN 'O' ELSE 'CB' END"


@query("pdb_round_trip", f"""WITH {POINTS} SELECT cid AS structure_id, (idx % 50 // 25)::INTEGER AS model, (idx % 50)::INTEGER AS atom_number, {NAME_SQL} AS atom_name, CASE WHEN chain < 5 THEN 'A' ELSE 'B' END AS chain,
  (idx % 50 // 5)::INTEGER AS resid, round(x,3) AS x, round(y,3) AS y, round(z,3) AS z, chain*10.0::DOUBLE AS b_factor, {NAME_SQL}[1] AS element FROM pts""")
def pdb_round_trip(t: Tables):
    lines = pdb.pdb_lines(_atom_table(t))
    lines = over_groups(lines, ["structure_id"], ["model", "part", "line_idx"], n=("row_number",))
    back = pdb.parse_atom_lines(lines.select("structure_id", F.col("n").alias("line_idx"), "line"), ["structure_id"])
    return back.select("structure_id", "model", "atom_number", "atom_name", "chain", "resid", "x", "y", "z", "b_factor", "element")


@query("pdb_line_layout", f"WITH {POINTS} SELECT cid AS structure_id, count(*) AS n, count(*)*80 AS characters FROM pts GROUP BY 1")
def pdb_line_layout(t: Tables):
    lines = _atom_table(t).select("structure_id", pdb.format_atom_line().alias("line"))
    return lines.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("characters"))


@query("multi_model_text", f"""WITH {POINTS}, b AS (SELECT DISTINCT cid, idx % 3 AS part, idx % 50 // 10 - 2 AS step FROM pts), n AS (SELECT cid, part, step, 1 + (cid + part) % 2 AS rep FROM b),
c AS (SELECT *, sum(rep) OVER (PARTITION BY cid ORDER BY part, step < 0, step) AS upto FROM n)
SELECT cid AS structure_id, max(upto)::BIGINT AS models, (SELECT count(*) FROM c d JOIN pts p ON p.cid=d.cid AND p.idx%3=d.part AND p.idx%50//10-2=d.step, range(1, 3) r(k) WHERE d.cid=c.cid AND k <= rep AND (p.idx % 5 <> 4 OR (upto - rep + k) = 1)) AS body_lines FROM c GROUP BY 1""")
def multi_model_text(t: Tables):
    """Every fifth line is a CONECT line, which only the first model keeps."""
    i = F.col("idx")
    blocks = t.points().select(
        F.col("cid").alias("structure_id"), (i % 3).alias("part"), (F.floor(i % 50 / 10) - 2).alias("step"), (1 + (F.col("cid") + i % 3) % 2).alias("repeat"),
        i.alias("line_idx"), F.concat(F.when(i % 5 == 4, "CONECT ").otherwise("ATOM "), i).alias("line"),
    )
    out = pdb.format_models(blocks)
    return out.groupBy("structure_id").agg(F.max("copy_no").alias("models"), F.count_if(F.col("section") == 1).alias("body_lines"))


@query("altloc_lines", f"WITH {POINTS} SELECT cid, idx, CASE idx % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' ' ELSE 'short' END AS mark FROM pts WHERE idx % 4 <> 2")
def altloc_lines(t: Tables):
    i = F.col("idx")
    head = F.rpad(F.concat(F.lit("ATOM "), i), 16, " ")
    line = F.when(i % 4 == 0, F.concat(head, F.lit("AASN"))).when(i % 4 == 1, F.concat(head, F.lit(" ASN"))).when(i % 4 == 2, F.concat(head, F.lit("BASN"))).otherwise(F.concat(F.lit("END "), i))
    out = pdb.rewrite_altloc_lines(t.points().select("cid", "idx", line.alias("line")))
    return out.select("cid", "idx", F.when(F.length("line") > 16, F.substring("line", 17, 1)).otherwise("short").alias("mark"))


CIF_HEAD = ("data_x", "#", "loop_", "_atom_site.group_PDB", "_atom_site.id", "_atom_site.type_symbol", "_atom_site.label_atom_id", "_atom_site.label_alt_id",
            "_atom_site.label_comp_id", "_atom_site.auth_asym_id", "_atom_site.auth_seq_id", "_atom_site.Cartn_x", "_atom_site.Cartn_y", "_atom_site.Cartn_z",
            "_atom_site.occupancy", "_atom_site.B_iso_or_equiv", "_atom_site.pdbx_PDB_model_num")


@query("mmcif_round_trip", f"""WITH {POINTS} SELECT cid AS structure_id, (idx % 50)::INTEGER AS atom_number, CASE WHEN idx % 5 = 4 THEN 'O5''' ELSE {NAME_SQL} END AS atom_name, CASE WHEN chain < 5 THEN 'A' ELSE 'B' END AS chain,
  round(x,3) AS x, round(z,3) AS z, CASE WHEN idx % 10 = 9 THEN 'H_LIG' ELSE ' ' END AS hetero FROM pts""")
def mmcif_round_trip(t: Tables):
    return pdb.parse_cif_lines(cif_lines(t), ["structure_id"]).select("structure_id", "atom_number", "atom_name", "chain", "x", "z", "hetero")


def cif_lines(t: Tables):
    """One mmCIF block per complex as numbered lines."""
    a = _atom_table(t)
    i = F.col("line_idx")
    het = i % 10 == 9
    name = F.when(i % 5 == 4, F.lit("\"O5'\"")).otherwise(F.col("atom_name"))
    row = F.concat_ws(
        " ", F.when(het, "HETATM").otherwise("ATOM"), "atom_number", "element", name, F.lit("."), F.when(het, "LIG").otherwise(F.col("resname")), "chain", "resid",
        F.format_string("%.3f", "x"), F.format_string("%.3f", "y"), F.format_string("%.3f", "z"), F.lit("1.0"), F.col("b_factor").cast("string"), F.col("model") + 1,
    )
    body = a.select("structure_id", (i % 50 + len(CIF_HEAD)).alias("line_idx"), row.alias("line"))
    head = a.select("structure_id").distinct().select("structure_id", F.posexplode(F.array(*[F.lit(h) for h in CIF_HEAD])).alias("line_idx", "line"))
    tail = a.select("structure_id").distinct().select("structure_id", F.lit(1000).alias("line_idx"), F.lit("#").alias("line"))
    return body.unionByName(head.withColumn("line_idx", F.col("line_idx").cast("long"))).unionByName(tail)


def _mol_lines(t: Tables):
    """One V2000 block per complex: its atoms (fifty; fewer where the table ends) and bonds between neighbours, as the counts line says."""
    i = F.col("idx") % 50
    tail = " ".join(["0"] * 12)
    p = t.points()
    atom = F.concat(F.format_string("%10.4f%10.4f%10.4f", "x", "y", "z"), F.lit(" "), F.rpad(F.when(i % 4 == 0, "N").otherwise("C"), 3, " "), F.lit(" " + tail[: 2 * 12 - 1]))
    atoms = p.select("cid", (i + 4).alias("line_idx"), atom.alias("line"))
    sizes = p.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.count_if(i < 49).alias("m"))
    bonds = p.where(i < 49).join(sizes, "cid").select("cid", (i + F.col("n") + 4).alias("line_idx"), F.concat(F.format_string("%3d%3d%3d", i + 1, i + 2, i % 3 + 1), F.lit("  0  0  0  0")).alias("line"))
    counts = F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", "n", "m")
    head = sizes.select("cid", F.posexplode(F.array(F.lit(""), F.lit("  own"), F.lit(""), counts)).alias("line_idx", "line"))
    end = sizes.select("cid", (F.col("n") + F.col("m") + 4).alias("line_idx"), F.lit("M  END").alias("line"))
    return atoms.unionByName(bonds).unionByName(head.withColumn("line_idx", F.col("line_idx").cast("long"))).unionByName(end)


@query("sdf_atoms", f"WITH {POINTS} SELECT cid, (idx % 50)::INTEGER AS idx, CASE WHEN idx % 50 % 4 = 0 THEN 'N' ELSE 'C' END AS symbol, round(x,4) AS x, round(y,4) AS y, round(z,4) AS z FROM pts")
def sdf_atoms(t: Tables):
    return lg.parse_mol_lines(_mol_lines(t), ["cid"])[0]


@query("sdf_bonds_repaired_counts", f"WITH {POINTS} SELECT cid, (idx % 50)::INTEGER AS a, (idx % 50 + 1)::INTEGER AS b, (idx % 50 % 3 + 1)::INTEGER AS bond_type FROM pts WHERE idx % 50 < 49")
def sdf_bonds_repaired_counts(t: Tables):
    broken = _mol_lines(t).withColumn("line", F.when(F.col("line_idx") == 3, F.lit("  9  9  0")).otherwise(F.col("line")))
    return lg.parse_mol_lines(broken, ["cid"], repair_counts=True)[1]


@query("directed_bonds", f"WITH {POINTS}, b AS (SELECT cid, idx % 50 AS a, idx % 50 + 1 AS b, idx % 50 % 3 + 1 AS k FROM pts WHERE idx % 50 < 49) SELECT cid, a::INTEGER AS src, b::INTEGER AS dst, k::INTEGER AS bond_type, (k=1)::INT || ',' || (k=2)::INT || ',' || (k=3)::INT || ',0' AS hot FROM b UNION ALL SELECT cid, b::INTEGER, a::INTEGER, k::INTEGER, (k=1)::INT || ',' || (k=2)::INT || ',' || (k=3)::INT || ',0' FROM b")
def directed_bonds(t: Tables):
    bonds = lg.parse_mol_lines(_mol_lines(t), ["cid"])[1]
    out = lg.directed_bonds(bonds, ["cid"])
    return out.select("cid", "src", "dst", "bond_type", F.array_join(F.col("type_one_hot").cast("array<string>"), ",").alias("hot"))


@query("score_report", "SELECT l_suppkey, 'T_' || l_partkey AS target, 'Q_' || l_orderkey AS query, l_quantity AS score, count(*) AS n FROM lineitem GROUP BY 1,2,3,4")
def score_report(t: Tables):
    rows = over_groups(t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), ["l_suppkey"], ["l_orderkey", "l_partkey", "l_linenumber"], n=("row_number",))
    four = F.array(
        F.concat(F.lit("target_name: T_"), "l_partkey"), F.concat(F.lit("query_name: Q_"), "l_orderkey"),
        F.concat(F.lit("optimal_alignment_score: "), F.col("l_quantity").cast("int"), F.lit("\tsuboptimal_alignment_score: 7\ttarget_end: 9")), F.lit(""),
    )
    lines = rows.select("l_suppkey", "n", F.posexplode(four).alias("k", "line")).select("l_suppkey", ((F.col("n") - 1) * 4 + F.col("k")).alias("line_idx"), "line")
    out = li.parse_score_report(lines, ["l_suppkey"])
    return out.groupBy("l_suppkey", "target", "query", "score").agg(F.count(F.lit(1)).alias("n"))


@query("pose_file_names", """SELECT l_orderkey, l_linenumber AS rank, l_discount AS lddt, l_tax AS affinity, CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity ELSE 0.0 END AS confidence, count(*) AS n FROM lineitem WHERE l_linenumber % 4 <> 3 GROUP BY 1,2,3,4,5""")
def pose_file_names(t: Tables):
    c = F.col
    stem = F.concat(F.lit("rank"), c("l_linenumber"), F.lit("_ligand_lddt"), F.format_string("%.2f", "l_discount"), F.lit("_affinity"), F.format_string("%.2f", "l_tax"))
    name = F.when(c("l_linenumber") % 4 == 3, F.concat(stem, F.lit("_relaxed.sdf"))).when(
        c("l_linenumber") % 2 == 0, F.concat(stem, F.lit("_confidence-"), F.format_string("%.1f", "l_quantity"), F.lit(".sdf"))
    ).otherwise(F.concat(stem, F.lit(".sdf")))
    out = ts.parse_pose_filenames(t.lineitem.select("l_orderkey", name.alias("file_name")))
    return out.groupBy("l_orderkey", "rank", "lddt", "affinity", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("numbered_lines", """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS characters FROM l GROUP BY 1""")
def numbered_lines(t: Tables):
    lines = li.explode_lines(t.documents.select("doc_id", "text"), "text", ["doc_id"])
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"))


@query("id_list", """WITH l AS (SELECT item_id, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) - 1 AS line_idx, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM benchmark)
SELECT item_id, line_idx, rtrim(line, ' ') AS id FROM l WHERE line_idx < 2""")
def id_list(t: Tables):
    lines = li.explode_lines(t.benchmark, "text", ["item_id"]).select("item_id", "line_idx", F.rtrim("line").alias("id"))
    return li.parse_ids(lines, 2)


@query("protein_stats_scan", "SELECT p_partkey, p_size FROM part WHERE p_size > 35 AND p_retailprice > 950")
def protein_stats_scan(t: Tables):
    return ts.read_stats(t.spark, f"{t.dir}/part.parquet").where("p_size > 35 AND p_retailprice > 950").select("p_partkey", "p_size")


@query("model_numbers", f"WITH {POINTS} SELECT cid, idx, (idx % 50 // 20)::INTEGER AS model FROM pts WHERE idx % 50 % 20 <> 0")
def model_numbers(t: Tables):
    i = F.col("idx") % 50
    lines = t.points().select("cid", "idx", i.alias("line_idx"), F.when(i % 20 == 0, "MODEL 1").otherwise("ATOM").alias("line"))
    return li.running_model(lines, ["cid"]).where("line = 'ATOM'").select("cid", "idx", "model")


@query("prediction_files", """WITH p AS (SELECT o_orderpriority AS batch, o_orderkey, o_totalprice FROM orders) SELECT substr(batch, 1, 1) AS batch, 'idx_' || o_orderkey AS name, o_totalprice AS affinity FROM p""")
def prediction_files(t: Tables):
    """Prediction files written per batch folder and read back as one table."""
    from structscreen.bindings.predictions import _run_folder

    folder = _run_folder(t, "batches")
    rows = t.orders.select(F.substring("o_orderpriority", 1, 1).alias("batch"), F.concat(F.lit("idx_"), "o_orderkey").alias("name"), F.col("o_totalprice").alias("affinity"))
    ts.write_screening_batches(rows, folder)
    return ts.read_screening_batches(t.spark, folder).select("batch", "name", "affinity")


