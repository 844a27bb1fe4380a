"""Checks that fail a job when its rows are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def must_be_empty(bad: DataFrame, message: Column, like: DataFrame) -> DataFrame:
    """No rows, typed like ``like``; any row in ``bad`` raises ``message`` instead.

    The bad rows are counted first: a filter on that count can neither be moved in front
    of the test for badness nor be dropped when only a row count is asked for.  Union it
    to a result to attach a check without shuffling the result.
    """
    found = bad.select(message.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m"))
    raising = found.where(F.when(F.col("n") > 0, F.raise_error(F.col("m")).cast("boolean")).otherwise(F.lit(False)))
    return raising.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])
