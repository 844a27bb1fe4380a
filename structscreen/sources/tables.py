"""Job, metadata, prediction and statistics tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOB_SCHEMA = "name string, protein_path string, ligand string, crystal_protein_path string"
STATS_SCHEMA = "id string, ptm double, plddt double, num_conf int, len int"
PREDICTION_SCHEMA = "name string, affinity double"


def read_jobs(spark: SparkSession, path, overrides: dict[str, str] | None = None, strip_names=True, required=("protein_path", "ligand")) -> DataFrame:
    """CSV with a header; every column is a string unless ``overrides`` names a type.

    Types are never inferred: a mask of zeros and ones would become a number.
    """
    df = spark.read.csv(path, header=True, inferSchema=False)
    if strip_names:
        df = df.toDF(*[c.strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for name, kind in (overrides or {}).items():
        if name in df.columns:
            value = F.col(name).try_cast(kind)
            if kind in ("double", "float"):  # NaN is no value anywhere in this library
                value = F.when(~F.isnan(value), value)
            df = df.withColumn(name, value)
    return df


def read_screening_batches(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Prediction files of all batch folders under ``root`` as one table with ``batch``.

    Without a schema the header names the columns; all but the name are numbers.  A file
    whose header differs is an error, so no column is lost or taken for another.
    """
    files = batch_files(root)
    if schema is None:
        names = spark.read.csv(files, header=True).columns
        schema = ", ".join(f"`{c}` {'string' if c == 'name' else 'double'}" for c in names)
    df = spark.read.schema(schema).csv(files, header=True, enforceSchema=False)
    return df.withColumn("batch", batch_of(F.input_file_name()))


def batch_files(root: str) -> str:
    """Glob of the prediction files: plain batch folders, or folders that Spark partitioned by batch and file."""
    return f"{root}/*/{{affinity_prediction.csv,file=affinity_prediction.csv}}"


def batch_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/=]+)/(?:file=)?affinity_prediction\.csv(?:/|$)", 1)


def write_screening_batches(predictions: DataFrame, root: str) -> None:
    """Predictions with a ``batch`` column into one folder per batch, in one pass."""
    predictions.withColumn("file", F.lit("affinity_prediction.csv")).write.partitionBy("batch", "file").csv(root, header=True)


def write_predictions(summary: DataFrame, complete: DataFrame, out: str, fmt="csv", mode="errorifexists") -> None:
    """Summary and complete prediction tables; a missing rank is written as an empty value."""
    if "rank" not in complete.columns:
        complete = complete.withColumn("rank", F.lit(None).cast("int"))
    complete = complete.select("name", "rank", "lddt", "affinity")
    for df, name in ((summary, "affinity_prediction"), (complete, "complete_affinity_prediction")):
        writer = df.write.mode(mode)
        writer.csv(f"{out}/{name}", header=True) if fmt == "csv" else writer.parquet(f"{out}/{name}")


def read_stats(spark: SparkSession, path) -> DataFrame:
    """Protein statistics; filters and column choices reach the parquet scan."""
    return spark.read.parquet(path)


# ------------------------------------------------------------------ pose file names
_FULL = r"^rank(\d+)_([^_]*)_lddt([-\d.]+)_affinity([-\d.]+)(?:_confidence([-\d.]+))?\.(?:sdf|pdb)$\R?"
_RANKED = r"^rank(\d+)_confidence([-\d.]+)\.sdf$"


def parse_pose_filenames(files: DataFrame, name: str = "file_name", ranked: bool = False) -> DataFrame:
    """Pose metadata from file names; names of no known form leave the result.

    ``ranked`` selects the form that carries only a rank and a confidence.
    """
    c = F.col(name)

    def skipped(n):
        return (n == "rank1.sdf") | F.contains(n, F.lit("_relaxed.")) | F.contains(n, F.lit("_step"))

    def part(pattern, group, kind):
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast(kind)

    if ranked:
        return files.where(~skipped(c) & c.rlike(_RANKED)).withColumns({
            "rank": part(_RANKED, 1, "int"), "role": F.lit("ligand"), "lddt": F.lit(None).cast("double"),
            "affinity": F.lit(None).cast("double"), "confidence": part(_RANKED, 2, "double"),
        })
    # One match per name: no part holds an underscore.  The name is held in a lambda variable, so that an expression
    # behind it is computed once and not for every use.
    def parts(n):
        told = F.transform(F.array(F.regexp_replace(n, _FULL, "/$1_$2_$3_$4_$5")), lambda r: F.when(r != n, F.split(r, "_")))[0]
        return F.when(~skipped(n), told)

    told = F.filter(F.transform(F.array(c), parts), lambda p: p.isNotNull())
    matched = files.select("*", F.explode(told).alias("__parts"))  # a filter would compute the parts once more

    def nth(i, kind):
        return F.nullif(F.ltrim(F.col("__parts")[i], F.lit("/")) if i == 0 else F.col("__parts")[i], F.lit("")).try_cast(kind)

    return matched.withColumns({
        "rank": nth(0, "int"), "role": nth(1, "string"), "lddt": nth(2, "double"), "affinity": nth(3, "double"),
        "confidence": F.when(F.col("__parts")[4] == "", F.lit(0.0)).otherwise(nth(4, "double")),
    }).drop("__parts")


def list_pose_files(spark: SparkSession, root: str) -> DataFrame:
    """File names below ``root`` without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))


def extract_annotations(df: DataFrame, text: str) -> DataFrame:
    from structscreen.functions.text import enzyme_class, fold_class

    return df.withColumns({"fold_class": fold_class(F.col(text)), "enzyme_class": enzyme_class(F.col(text))})


METADATA_TEXT = (
    "entryName proteinName compoundName uid pdbFile ligandFile af2File pdb comp_id smiles superfamily "
    "superfamily_by_clster30 family raw_af2File uid_entry result_seq_ref result_seq_pdb raw_result_ref "
    "gap_mask ligand protein_path"
).split()


def metadata_schema(columns) -> T.StructType:
    """Explicit schema of a metadata table: known text columns, a date, else numbers."""
    integers = {
        "protein_length", "filled_num", "n_atoms", "len_info", "len_ref_seq", "len_pdb_seq",
        "start_idx", "end_idx", "clash_n", "n", "year", "pubmed",
    }

    def kind(c):
        if c in METADATA_TEXT:
            return T.StringType()
        if c == "initial_release_date":
            return T.DateType()
        if c in integers or c.startswith("cluster_id_"):
            return T.IntegerType()
        return T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])
