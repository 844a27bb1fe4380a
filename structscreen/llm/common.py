"""What the operators of this folder share: words, shared storage, written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words; everything else belongs to a word.
WORD_BREAKS = " \t\n\x0b\f\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_array(text) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; a null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), WORD_SPLIT), "")


def words_of(text: str | None) -> list[str]:
    """The same words in Python.  ``str.split`` without arguments would split on more."""
    if not text:
        return []
    for mark in WORD_BREAKS[1:]:
        if mark in text:
            text = text.replace(mark, " ")
    words = text.split(" ")
    return [w for w in words if w] if "" in words else words


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the storage that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``.  Only a purely local session (one process) may go
    without that setting; there a folder of this machine is shared by definition.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *, release: bool = False, **options) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, written with ``options``: lineage ends here.

    A lost executor costs nothing that was written before.  With ``release`` the exchanges behind the table go as soon as it is
    written, not when the driver's JVM collects them.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    if release:
        spark.conf.set(_CLEANUP, "true")
        df = df.select("*")  # the setting holds for plans made under it
    try:
        df.write.options(**options).parquet(path)
    finally:
        if release:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
