"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structscreen.plans.skew import over_groups


def explode_lines(files: DataFrame, text: str = "value", keep=("file",)) -> DataFrame:
    """One row per line (``line_idx``, ``line``) of a whole-text column."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n$", "")
    return files.select(*keep, F.posexplode(F.split(body, "\n")).alias("line_idx", "line")).withColumn(
        "line_idx", F.col("line_idx").cast("long")
    )


#: Patterns for ``id_of``: the file name without folder and last extension.
STEM = r"([^/]+?)(?:\.[^./]*)?$"


def id_of(file: Column, pattern: str | None = None) -> Column:
    """Id of a file's rows: its whole path, or the first group of ``pattern`` in the path.

    Only the path is unique over many folders; result layouts repeat file names.
    """
    return file if pattern is None else F.regexp_extract(file, pattern, 1)


def numbered_pieces(spark: SparkSession, paths, separator: str, folders: bool = False) -> DataFrame:
    """(file, n, value): pieces between separators, numbered from 0 in file order.

    With ``folders`` the files of a folder are one text in the order of their names, as Spark writes
    a sorted table, and ``file`` is the folder.

    Files stay splittable and nothing leaves the JVM.  A piece's number in its split comes
    from the running row id; the pieces of earlier splits are added from a table of one row
    per split, so no key holds more than one split.
    """
    raw = spark.read.option("lineSep", separator).text(paths).select(
        F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__m"), "value",
    )
    splits = raw.groupBy("__path", "__b").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    splits = splits.withColumn("file", F.regexp_extract("__path", r"^(.*/)", 1) if folders else F.col("__path"))
    before = Window.partitionBy("file").orderBy("__path", "__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")
    starts = splits.select("file", F.col("__path").alias("__f"), F.col("__b").alias("__s"), shift.alias("__shift"))
    at = (F.col("__path") == F.col("__f")) & (F.col("__b") == F.col("__s"))
    return raw.join(starts, at).select("file", (F.col("__m") + F.col("__shift")).alias("n"), "value")


def with_line_idx(spark: SparkSession, paths, folders: bool = False) -> DataFrame:
    """Numbered lines per file, or per folder of files in the order of their names: (file, line_idx, line)."""
    return numbered_pieces(spark, paths, "\n", folders).select("file", F.col("n").alias("line_idx"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_ids(spark: SparkSession, path, limit: int | None = None) -> DataFrame:
    """Id list, one per line, right-trimmed; optionally only the first ``limit`` lines."""
    lines = with_line_idx(spark, path).select("line_idx", F.rtrim("line").alias("id"))
    return parse_ids(lines, limit)


def parse_ids(lines: DataFrame, limit: int | None = None) -> DataFrame:
    return lines if limit is None else lines.where(F.col("line_idx") < limit)


def parse_score_report(lines: DataFrame, by=("file",)) -> DataFrame:
    """Pairwise score report in blocks of four lines: target, query, score, blank."""
    block = F.floor(F.col("line_idx") / 4)
    part = F.pmod(F.col("line_idx"), F.lit(4))
    last_word = F.element_at(F.split(F.trim("line"), " "), -1)
    score = F.regexp_extract("line", r"(?:^|\t)optimal_alignment_score: ([-+.\deE]+)", 1)
    return (
        lines.groupBy(*by, block.alias("block"))
        .agg(
            F.max(F.when((part == 0) & F.contains("line", F.lit("target_name")), last_word)).alias("target"),
            F.max(F.when((part == 1) & F.contains("line", F.lit("query_name")), last_word)).alias("query"),
            F.max(F.when((part == 2), F.nullif(score, F.lit("")).cast("double"))).alias("score"),
        )
        .where(F.col("score").isNotNull())
    )


def read_score_report(spark: SparkSession, path) -> DataFrame:
    return parse_score_report(with_line_idx(spark, path))


def running_model(lines: DataFrame, by=("file",)) -> DataFrame:
    """Model number of each line: 0-based count of MODEL records so far, 0 without any."""
    is_model = F.substring("line", 1, 6).isin("MODEL ", "MODEL").cast("int")
    out = over_groups(
        lines.withColumn("__m", is_model), by, ["line_idx"], model=("sum", "__m")
    )
    return out.withColumn("model", F.greatest(F.col("model") - 1, F.lit(0)).cast("int")).drop("__m")
