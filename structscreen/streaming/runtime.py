"""User scoring functions: batches, repeats, retries, time limits, table functions."""

from __future__ import annotations

import signal
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


def score_complexes(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, samples=1, batch_size=32, partitions=None) -> DataFrame:
    """Run a user model on every complex ``samples`` times, in batches.

    ``fn`` gets a pandas frame of at most ``batch_size`` rows with an added ``sample_no``
    and returns rows of ``schema``.  Samples are spread over tasks, so a complex with many
    samples does not stay in one task.  The frames that ``fn`` returns travel back together, those of
    one Arrow batch in one.
    """
    jobs = df.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    if partitions:
        jobs = jobs.repartition(partitions)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.concat([fn(pdf.iloc[i:i + batch_size]) for i in range(0, len(pdf), batch_size)], ignore_index=True)

    return jobs.mapInPandas(run, schema)


class _OutOfTime(Exception):
    pass


def _limited(fn, row, seconds):
    if not seconds:
        return fn(row)

    def on_alarm(signum, frame):
        raise _OutOfTime()

    old = signal.signal(signal.SIGALRM, on_alarm)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return fn(row)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def robust_map(df: DataFrame, fn: Callable[[dict], dict], schema: str, *, retries=1, timeout_s: float | None = None, fallback: dict | None = None) -> DataFrame:
    """Row function with status: ok, timeout (fallback values) or failed (nulls).

    An exception gets ``retries`` more chances; running out of time gets none.  Input
    columns stay; result columns and ``status`` and ``error`` are added.
    """
    out_fields = T.StructType.fromDDL(schema).fieldNames()
    full = T.StructType([
        *df.schema.fields, *T.StructType.fromDDL(schema).fields,
        T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
    ])
    blank = {c: None for c in out_fields}

    def one(row):
        error = ""
        for _ in range(retries + 1):
            try:
                return {**blank, **_limited(fn, row, timeout_s), "status": "ok", "error": None}
            except _OutOfTime:
                return {**blank, **(fallback or {}), "status": "timeout", "error": "out of time"}
            except Exception as e:  # a bad row must not end the job
                error = f"{type(e).__name__}: {e}"
        return {**blank, "status": "failed", "error": error}

    def run(batches):
        for pdf in batches:
            rows = pdf.to_dict("records")
            yield pd.DataFrame([{**r, **one(r)} for r in rows], columns=full.fieldNames())

    return df.mapInPandas(run, full)


@udtf(returnType="rec_idx: int, label: string, sequence: string")
class FastaRows:
    """SQL table function: records of one FASTA text."""

    def eval(self, text: str):
        for i, record in enumerate((text or "").lstrip().lstrip(">").split("\n>")):
            if record:
                head, _, body = record.partition("\n")
                yield i, head.strip(), "".join(line.strip() for line in body.split("\n"))


@udtf(returnType="col: int, ref_char: string, mod_char: string, ref_idx: int, mod_idx: int")
class AlignmentRows:
    """SQL table function: columns of one alignment."""

    def eval(self, ref: str, mod: str):
        r = m = 0
        for col, (a, b) in enumerate(zip(ref, mod, strict=True)):
            yield col, a, b, (r if a != "-" else None), (m if b != "-" else None)
            r += a != "-"
            m += b != "-"


def register_table_functions(spark) -> None:
    spark.udtf.register("fasta_rows", FastaRows)
    spark.udtf.register("alignment_rows", AlignmentRows)
