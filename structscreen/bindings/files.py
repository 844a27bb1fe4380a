"""Files written from the tables into the shared folder and read back by the file readers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscreen.bindings.core import POINTS, Tables, query
from structscreen.bindings.text_records import NAME_SQL, _atom_table, _mol_lines, cif_lines
from structscreen.plans.skew import checkpoint_folder
from structscreen.sources import fasta as fa
from structscreen.sources import ligand as lg
from structscreen.sources import lines as li
from structscreen.sources import pdb
from structscreen.sources import tables as ts


def _folder(t: Tables, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid4().hex}"


def _write_lines(lines: DataFrame, by: str, path: str, parts: bool = False) -> None:
    """Numbered lines as one text folder per value of ``by``: one file, or with ``parts`` as many as tasks sort it."""
    kept = lines.select(by, "line_idx", F.col("line").alias("value"))
    dealt = kept.repartitionByRange(by, "line_idx") if parts else kept.repartition(by)
    dealt.sortWithinPartitions(by, "line_idx").select(by, "value").write.partitionBy(by).text(path)


def _number_in(name: str) -> str:
    return rf"{name}(?:=|%3D)(-?\d+)/"


@query("jobs_file", """SELECT 'job_' || c_custkey AS name, c_name AS protein_path, 'lig' || c_nationkey AS ligand, c_mktsegment AS crystal_protein_path, c_acctbal::DOUBLE AS weight, lpad((c_custkey % 100)::VARCHAR, 4, '0') AS mask FROM customer""")
def jobs_file(t: Tables):
    """A mask of digits stays text; only the column named gets a type."""
    folder = _folder(t, "jobs")
    c = F.col
    t.customer.select(
        F.concat(F.lit("job_"), "c_custkey").alias("name"), c("c_name").alias("protein_path"), F.concat(F.lit("lig"), "c_nationkey").alias("ligand"), c("c_mktsegment").alias("crystal_protein_path"),
        c("c_acctbal").alias("weight"), F.lpad((c("c_custkey") % 100).cast("string"), 4, "0").alias("mask"),
    ).write.csv(folder, header=True)
    return ts.read_jobs(t.spark, folder, {"weight": "double"}).select("name", "protein_path", "ligand", "crystal_protein_path", "weight", "mask")


@query("prediction_tables", """SELECT 'summary' AS kind, l_orderkey || '_' || l_linenumber AS name, 0 AS rank, 0.0::DOUBLE AS lddt, l_extendedprice AS affinity FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'complete', l_orderkey || '_' || l_linenumber, l_linenumber::INTEGER, l_discount, l_extendedprice FROM lineitem""")
def prediction_tables(t: Tables):
    folder = _folder(t, "predictions")
    c = F.col
    name = F.concat_ws("_", "l_orderkey", "l_linenumber").alias("name")
    rows = t.lineitem.select(name, c("l_linenumber").cast("int").alias("rank"), c("l_discount").alias("lddt"), c("l_extendedprice").alias("affinity"))
    ts.write_predictions(rows.where("rank = 1").select("name", "affinity"), rows, folder, fmt="parquet")
    summary = t.spark.read.parquet(f"{folder}/affinity_prediction").select(
        F.lit("summary").alias("kind"), "name", F.lit(0).alias("rank"), F.lit(0.0).alias("lddt"), "affinity"
    )
    complete = t.spark.read.parquet(f"{folder}/complete_affinity_prediction").select(F.lit("complete").alias("kind"), "name", "rank", "lddt", "affinity")
    return summary.unionByName(complete)


@query("pdb_files", f"""WITH {POINTS} SELECT cid::VARCHAR AS structure_id, (idx % 50 // 25)::INTEGER AS model, (idx % 50)::INTEGER AS atom_number, {NAME_SQL} AS atom_name, CASE WHEN chain < 5 THEN 'A' ELSE 'B' END AS chain,
  round(x,3) AS x, round(y,3) AS y, round(z,3) AS z FROM pts""")
def pdb_files(t: Tables):
    """One folder per structure, all files of one name: the id comes from the path."""
    folder = _folder(t, "pdb")
    pdb.write_pdb(_atom_table(t), folder)
    back = pdb.read_pdb(t.spark, f"{folder}/structure_id=*", id_pattern=_number_in("structure_id"))
    return back.select("structure_id", "model", "atom_number", "atom_name", "chain", "x", "y", "z")


@query("mmcif_files", f"""WITH {POINTS} SELECT cid::VARCHAR AS structure_id, (idx % 50)::INTEGER AS atom_number, CASE WHEN idx % 5 = 4 THEN 'O5''' ELSE {NAME_SQL} END AS atom_name, round(x,3) AS x, round(z,3) AS z FROM pts""")
def mmcif_files(t: Tables):
    folder = _folder(t, "mmcif")
    _write_lines(cif_lines(t), "structure_id", folder)
    back = pdb.read_mmcif(t.spark, f"{folder}/structure_id=*", id_pattern=_number_in("structure_id"))
    return back.select("structure_id", "atom_number", "atom_name", "x", "z")


@query("sdf_files", f"""WITH {POINTS} SELECT (cid // 2)::VARCHAR AS mol_id, (cid % 2)::INTEGER AS record_idx, (idx % 50)::INTEGER AS idx, CASE WHEN idx % 50 % 4 = 0 THEN 'N' ELSE 'C' END AS symbol, round(x,4) AS x, round(y,4) AS y, round(z,4) AS z FROM pts""")
def sdf_files(t: Tables):
    """Two blocks per file."""
    folder = _folder(t, "sdf")
    lines = _mol_lines(t)
    ends = lines.select("cid").distinct().select("cid", F.lit(104).cast("long").alias("line_idx"), F.lit("$$$$").alias("line"))
    both = lines.unionByName(ends).select(F.floor(F.col("cid") / 2).alias("mol"), (F.col("line_idx") + F.col("cid") % 2 * 200).alias("line_idx"), "line")
    _write_lines(both, "mol", folder)
    return lg.read_sdf(t.spark, f"{folder}/mol=*", id_pattern=_number_in("mol"))[0].select("mol_id", "record_idx", "idx", "symbol", "x", "y", "z")


@query("fasta_files", """SELECT (s_suppkey % 7)::VARCHAR AS file_no, s_suppkey AS label, replace(replace(s_name, '#', ''), '0', 'A') || repeat('MK', 40) AS sequence FROM supplier""")
def fasta_files(t: Tables):
    """Records over several lines, seven files; labels are unique in a file."""
    folder = _folder(t, "fasta")
    seq = F.concat(F.replace(F.replace("s_name", F.lit("#"), F.lit("")), F.lit("0"), F.lit("A")), F.lit("MK" * 40))
    record = F.array(F.concat(F.lit(">"), F.col("s_suppkey").cast("string")), F.substring(seq, 1, 30), F.substring(seq, 31, 1000))
    rows = t.supplier.select((F.col("s_suppkey") % 7).alias("no"), "s_suppkey", F.posexplode(record).alias("k", "line"))
    _write_lines(rows.select("no", (F.col("s_suppkey") * 3 + F.col("k")).alias("line_idx"), "line"), "no", folder)
    back = fa.read_fasta(t.spark, f"{folder}/no=*")
    return back.select(li.id_of(F.col("file"), _number_in("no")).alias("file_no"), F.col("label").cast("long").alias("label"), "sequence")


@query("line_files", """SELECT (l_suppkey % 5)::VARCHAR AS file_no, row_number() OVER (PARTITION BY l_suppkey % 5 ORDER BY l_orderkey, l_linenumber) - 1 AS line_idx, l_orderkey || ' ' || l_linenumber AS line FROM lineitem""")
def line_files(t: Tables):
    """Line numbers of texts in several files that are read in several splits."""
    folder = _folder(t, "lines")
    rows = t.lineitem.select((F.col("l_suppkey") % 5).alias("no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_idx"), F.concat_ws(" ", "l_orderkey", "l_linenumber").alias("line"))
    _write_lines(rows, "no", folder, parts=True)
    back = li.with_line_idx(t.spark, f"{folder}/no=*", folders=True)
    return back.select(li.id_of(F.col("file"), _number_in("no")).alias("file_no"), "line_idx", "line")
