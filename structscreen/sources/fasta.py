"""FASTA and A3M."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structscreen.functions.text import msa_view
from structscreen.plans.checks import must_be_empty
from structscreen.plans.skew import over_groups
from structscreen.sources.lines import id_of, numbered_pieces


def parse_records(records: DataFrame, text="value", keep=("file", "rec_idx"), line_idx: str | None = None) -> DataFrame:
    """(label, sequence) from one text per record, header first, with or without '>'."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), "^>", ""), "\r", "")
    header = F.trim(F.split(body, "\n", 2)[0])
    rest = F.coalesce(F.get(F.split(body, "\n", 2), F.lit(1)), F.lit(""))
    label = header
    if line_idx:
        label = F.when(header == "", F.format_string("seqnum%09d", F.col(line_idx))).otherwise(header)
    return records.select(
        *keep, label.alias("label"), F.regexp_replace(rest, r"\s*\n\s*|^\s+|\s+$", "").alias("sequence")
    )


def _numbered_records(spark: SparkSession, paths) -> DataFrame:
    """(file, rec_idx, first_line, value): records in file order with their header's line number.

    The separator "newline plus >" keeps files splittable; line numbers come from a running
    sum of the lines of earlier records.
    """
    numbered = numbered_pieces(spark, paths, "\n>").withColumnRenamed("n", "rec_idx")
    lines = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit(""))) + 1
    return over_groups(
        numbered.withColumn("__l", lines.cast("long")), ["file"], ["rec_idx"], split=True, __upto=("sum", "__l")
    ).select("file", "rec_idx", (F.col("__upto") - F.col("__l")).alias("first_line"), "value")


def check_unique_labels(seqs: DataFrame, by=("file",)) -> DataFrame:
    """The same rows; computing them fails if a label occurs twice in a file."""
    twice = seqs.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    message = F.concat(F.lit("duplicate sequence label "), F.col("label"))
    return seqs.unionByName(must_be_empty(twice, message, seqs))  # only labels are shuffled


def read_fasta(spark: SparkSession, paths, on_duplicate: str = "error") -> DataFrame:
    """(file, rec_idx, label, sequence).  An empty header becomes seqnum<line number>."""
    records = _numbered_records(spark, paths)
    seqs = parse_records(records, keep=("file", "rec_idx"), line_idx="first_line")
    return check_unique_labels(seqs) if on_duplicate == "error" else seqs


def read_msa(spark: SparkSession, paths, nseq: int | None = None, keep_gaps=True, keep_insertions=True, to_upper=False, id_pattern: str | None = None) -> DataFrame:
    """(msa_id, rec_idx, label, sequence) of alignment files; labels may be empty or repeated."""
    records = parse_records(_numbered_records(spark, paths))
    return msa_rows(records.withColumn("msa_id", id_of(F.col("file"), id_pattern)), nseq, keep_gaps, keep_insertions, to_upper)


def msa_rows(records: DataFrame, nseq=None, keep_gaps=True, keep_insertions=True, to_upper=False) -> DataFrame:
    rows = records if nseq is None else records.where(F.col("rec_idx") < nseq)
    view = msa_view(F.col("sequence"), keep_gaps, keep_insertions, to_upper)
    return rows.select("msa_id", "rec_idx", "label", view.alias("sequence"))


def check_equal_length(msa: DataFrame, by=("msa_id",)) -> DataFrame:
    """One row per alignment (rows, columns); computing it fails on ragged rows."""
    n = F.length("sequence")
    stats = msa.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("__lo"), F.max(n).alias("__hi"))
    width = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(
        F.raise_error(F.lit("alignment rows differ in length")).cast("int")
    )
    return stats.select(*by, "rows", width.alias("columns"))


def fasta_text(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), F.col("label"), F.lit("\n"), F.col("sequence")).alias("value"))


def write_fasta(seqs: DataFrame, path: str, mode="errorifexists") -> None:
    fasta_text(seqs).write.mode(mode).text(path)


def split_header(df: DataFrame, names, types=None) -> DataFrame:
    """Columns from a '|' separated header."""
    types = types or ["string"] * len(names)
    parts = F.split("label", r"\|")
    return df.withColumns({n: F.get(parts, F.lit(i)).try_cast(t) for i, (n, t) in enumerate(zip(names, types))})
