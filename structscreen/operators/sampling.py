"""Reproducible samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscreen.functions.text import DRAW_MODULUS, draw
from structscreen.plans.skew import attach, over_groups


def sample_key(name):
    """Second '_' part of a name, or the whole name without one."""
    return F.coalesce(F.get(F.split(name, "_"), F.lit(1)), F.col(name) if isinstance(name, str) else name)


def balanced_sample(df: DataFrame, key: str, n: int | None = None, *, order, seed=0) -> DataFrame:
    """n rows with replacement, each row weighted by 1 / size of its key group.

    With those weights a draw is a uniform key and then a uniform row of that key, so a
    draw is two numbers and two equi-joins; no cumulative weights are built.  ``n``
    defaults to the number of rows.
    """
    spark = df.sparkSession
    rows = over_groups(df, [key], list(order), split=True, __row=("row_number",))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__size"))
    keys = over_groups(sizes, [], [key], __key_no=("row_number",))
    if n is None:
        n = df.count()
    n_keys = keys.agg(F.count(F.lit(1))).scalar()
    draws = spark.range(n).select(F.col("id").alias("draw_no"))
    picked = draws.select(
        "draw_no", (F.pmod(draw(seed, F.col("draw_no")), n_keys) + 1).alias("__key_no"),
        draw(seed + 1, F.col("draw_no")).alias("__d"),
    ).join(keys, "__key_no", "inner")
    picked = picked.select("draw_no", key, (F.pmod(F.col("__d"), F.col("__size")) + 1).alias("__row"))
    return picked.join(rows, [key, "__row"], "inner").drop("__row")


def balanced_pick(samples: DataFrame, by: str, *, rmsd="rmsd", cutoff=2.0, order=("sample_no",), seed=0, hash_key: str) -> DataFrame:
    """One sample per complex: a drawn label decides between failures and successes.

    Label 0 takes a failure if there is one, else a success; label 1 takes a success if
    there is one.  A complex with neither keeps a row without a sample.
    """
    ok = (F.col(rmsd) < cutoff).cast("int")
    rows = over_groups(samples.withColumn("__ok", ok), [by, "__ok"], list(order), split=True, __n=("row_number",))
    sizes = samples.groupBy(by).agg(
        F.sum(ok).alias("__s"), F.count(F.lit(1)).alias("__all"), F.min(hash_key).alias("__h")
    )
    label = F.pmod(draw(seed, F.col("__h")), F.lit(2)).cast("int")
    want = sizes.withColumn("label", label).withColumn(
        "__ok", F.when((F.col("label") == 0) & (F.col("__s") < F.col("__all")), 0).when(F.col("__s") > 0, 1)
    )
    pool = F.when(F.col("__ok") == 1, F.col("__s")).otherwise(F.col("__all") - F.col("__s"))
    want = want.withColumn("__n", F.pmod(draw(seed + 1, F.col("__h")), pool) + 1).select(by, "label", "__ok", "__n")
    return want.join(rows, [by, "__ok", "__n"], "left").drop("__ok", "__n")


def sample_n(df: DataFrame, n: int, *, keys, seed=0) -> DataFrame:
    """n rows without replacement: the rows with the smallest draws.

    Only rows below a draw that a few more than n are expected to stay under are numbered; should they be fewer than n, all are.
    """
    drawn = df.withColumn("__d", draw(seed, *[F.col(c) for c in keys]))
    total = df.agg(F.count(F.lit(1))).scalar()
    cut = F.lit(float(DRAW_MODULUS) * (n + 8 * n ** 0.5 + 64)) / F.greatest(total, F.lit(1))
    enough = drawn.where(F.col("__d") < cut).agg(F.count(F.lit(1)) >= n).scalar()
    numbered = over_groups(drawn.where((F.col("__d") < cut) | ~enough), [], ["__d", *keys], __i=("row_number",))
    return numbered.where(F.col("__i") <= n).drop("__d", "__i")


def split_frac(df: DataFrame, frac: float, *, keys, seed=0, out="is_train") -> DataFrame:
    """Mark exactly floor(frac * rows) rows as train."""
    total = df.agg(F.count(F.lit(1))).scalar()
    numbered = over_groups(df.withColumn("__d", draw(seed, *[F.col(c) for c in keys])), [], ["__d", *keys], __i=("row_number",))
    return numbered.withColumn(out, F.col("__i") <= F.floor(total * F.lit(frac))).drop("__d", "__i")


def group_kfold(df: DataFrame, level: str, k: int = 5) -> DataFrame:
    """``part`` 0..k-1 such that no class of ``level`` spans two parts."""
    classes = over_groups(df.select(level).distinct(), [], [level], __i=("row_number",))
    parts = classes.select(level, F.pmod(F.col("__i") - 1, F.lit(k)).cast("int").alias("part"))
    return attach(df, parts, [level])


def fold_split(df: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """(train, held out): the held-out part and the other ones."""
    return df.where(F.col("part") != part), df.where(F.col("part") == part)
