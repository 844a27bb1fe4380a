"""Query registry and the roles the test tables play."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structscreen.plans.session import tune

REGISTRY: dict[str, "Query"] = {}


@dataclass
class Query:
    run: object
    sql: str | None


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(Tables(tune(spark), sf_dir)))

        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return fn

    return register


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation: doubles with six digits, negative zero as zero."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema
    ])


# SQL for the same roles -------------------------------------------------------------
POSES = """poses AS (
  SELECT l_orderkey AS entryName, l_returnflag AS conformation, l_linestatus AS dataset_name,
         l_linenumber AS rank, l_extendedprice/10000 AS affinity, l_discount AS clashScore,
         l_quantity/8 AS rmsd, l_tax*100 AS pocket_rmsd, 1-l_discount AS lddt, l_partkey, l_suppkey, l_linenumber
  FROM lineitem)"""
RANKED = POSES + """, ranked AS (
  SELECT *, rank() OVER (PARTITION BY entryName, conformation ORDER BY clashScore)
           + (count(*) OVER (PARTITION BY entryName, conformation, clashScore) - 1)/2.0 AS clash_rank,
         rank() OVER (PARTITION BY entryName, conformation ORDER BY affinity DESC)
           + (count(*) OVER (PARTITION BY entryName, conformation, affinity) - 1)/2.0 AS affinity_rank
  FROM poses)"""
POINTS = """pts AS (
  SELECT vec_id // 50 AS cid, vec_id AS idx, label AS chain,
         embedding[1]::DOUBLE*20 AS x, embedding[2]::DOUBLE*20 AS y, embedding[3]::DOUBLE*20 AS z,
         embedding[4]::DOUBLE*20 AS lx, embedding[5]::DOUBLE*20 AS ly, embedding[6]::DOUBLE*20 AS lz,
         embedding[1]::DOUBLE*20+embedding[7]::DOUBLE AS mx, embedding[2]::DOUBLE*20+embedding[8]::DOUBLE AS my,
         embedding[3]::DOUBLE*20+embedding[9]::DOUBLE AS mz
  FROM embeddings)"""
SEQS = """seqs AS (
  SELECT doc_id, source, source || '_' || doc_id AS label, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)"""
# an alignment: the reference lacks every 11th column, the model every 7th, every 13th differs
CHARS = SEQS + """, cols AS (
  SELECT doc_id, generate_subscripts(string_split(sequence, ''), 1) - 1 AS col, unnest(string_split(sequence, '')) AS ch FROM seqs WHERE sequence <> '')"""
ALIGNED = CHARS + """,
aln AS (
  SELECT doc_id, col, ch, CASE WHEN col % 11 = 5 AND col % 7 <> 3 THEN '-' ELSE ch END AS ref_char,
         CASE WHEN col % 7 = 3 THEN '-' WHEN col % 13 = 2 THEN 'X' ELSE ch END AS mod_char
  FROM cols)"""


class Tables:
    """Test tables read on demand, and the roles they play."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """A test table over all cores: each is one row group, which one task would read and work on."""
        return df.repartition(self.spark.sparkContext.defaultParallelism, key)

    def poses(self) -> DataFrame:
        c = F.col
        return self.lineitem.select(
            c("l_orderkey").alias("entryName"), c("l_returnflag").alias("conformation"), c("l_linestatus").alias("dataset_name"),
            c("l_linenumber").alias("rank"), (c("l_extendedprice") / 10000).alias("affinity"), c("l_discount").alias("clashScore"),
            (c("l_quantity") / 8).alias("rmsd"), (c("l_tax") * 100).alias("pocket_rmsd"), (1 - c("l_discount")).alias("lddt"),
            "l_partkey", "l_suppkey", "l_linenumber",
        )

    def points(self) -> DataFrame:
        """Complexes of 50 points: x y z, a ligand point lx ly lz, a model place mx my mz."""
        e = [F.col("embedding")[i].cast("double") for i in range(9)]
        xyz = [e[i] * 20 for i in range(6)]
        return self.embeddings.select(
            F.floor(F.col("vec_id") / 50).alias("cid"), F.col("vec_id").alias("idx"), F.col("label").alias("chain"),
            *[xyz[i].alias(c) for i, c in enumerate("xyz")], *[xyz[3 + i].alias("l" + c) for i, c in enumerate("xyz")],
            *[(xyz[i] + e[6 + i]).alias("m" + c) for i, c in enumerate("xyz")],
        )

    def ligand(self) -> DataFrame:
        """Ligand atoms: the l* place of every point of a complex."""
        return self.points().select("cid", F.col("idx").alias("lig_idx"), "chain", *[F.col("l" + c).alias(c) for c in "xyz"])

    def seqs(self) -> DataFrame:
        seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
        return self.dealt(self.documents.select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", F.concat_ws("_", "source", "doc_id").alias("label"), seq.alias("sequence"))

    def aligned(self) -> DataFrame:
        """(doc_id, ref_aln, mod_aln) by the rules of the SQL form."""
        @F.arrow_udf("struct<ref_aln: string, mod_aln: string>")
        def sides(texts: pa.Array) -> pa.Array:
            refs, mods = [], []
            for t in texts.to_pylist():  # letters A-Z only
                ref, mod = (np.frombuffer(bytearray(t, "ascii"), dtype=np.uint8) for _ in range(2))
                i = np.arange(len(ref))
                ref[(i % 11 == 5) & (i % 7 != 3)] = ord("-")
                mod[i % 13 == 2] = ord("X")
                mod[i % 7 == 3] = ord("-")
                refs.append(ref.tobytes().decode())
                mods.append(mod.tobytes().decode())
            return pa.StructArray.from_arrays([pa.array(refs, pa.string()), pa.array(mods, pa.string())], ["ref_aln", "mod_aln"])

        return self.seqs().where("sequence <> ''").select("doc_id", "sequence", sides("sequence").alias("s")).select("doc_id", "sequence", "s.*")
