"""Token-budget batches and diverse subsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscreen.plans.skew import attach, cut_lineage, over_groups


def _fold_padded(budget):
    def fold(batches):
        batch, used = 0, 0  # used: rows in the open batch
        for pdf in batches:
            out = []
            for length, n in zip(pdf["__len"].tolist(), pdf["__n"].tolist()):
                cap = max(1, budget // length) if length > 0 else n + used
                if used >= cap and used > 0 or (used > 0 and length * (used + 1) > budget):
                    batch, used = batch + 1, 0
                first = min(n, cap - used)
                out.append((length, batch, first, cap))
                rest = n - first
                batch += -(-rest // cap)
                used = used + first if rest == 0 else (rest - 1) % cap + 1
            yield pd.DataFrame(out, columns=["__len", "__batch", "__first", "__cap"])
    return fold


def _fold_additive(budget):
    def fold(batches):
        batch, used = 0, 0  # used: tokens in the open batch
        for pdf in batches:
            out = []
            for length, n in zip(pdf["__len"].tolist(), pdf["__n"].tolist()):
                if length == 0:
                    out.append((length, batch, n, 1))
                    continue
                cap = max(1, budget // length)
                if used > 0 and used + length > budget:
                    batch, used = batch + 1, 0
                first = min(n, max(1, (budget - used) // length) if used == 0 else (budget - used) // length)
                out.append((length, batch, first, cap))
                rest = n - first
                batch += -(-rest // cap)
                used = used + first * length if rest == 0 else ((rest - 1) % cap + 1) * length
            yield pd.DataFrame(out, columns=["__len", "__batch", "__first", "__cap"])
    return fold


def _pack(df: DataFrame, length: str, order, fold) -> DataFrame:
    """Greedy batches over rows sorted by (length, order), exact and without a row loop.

    Rows of one length are interchangeable to the greedy rule, so it only has to walk over
    the histogram of lengths: for each distinct length it gives the open batch, how many
    rows still go there and how many a full batch takes.  The histogram has at most as
    many rows as the longest sequence has symbols; the rows themselves then get their
    batch from their number among the rows of the same length.
    """
    histogram = df.groupBy(F.col(length).cast("long").alias("__len")).agg(F.count(F.lit(1)).alias("__n"))
    plan = histogram.repartition(1).sortWithinPartitions("__len").mapInPandas(
        fold, "__len long, __batch long, __first long, __cap long"
    )
    numbered = over_groups(df.withColumn("__len", F.col(length).cast("long")), ["__len"], list(order), split=True, __i=("row_number",))
    out = attach(numbered, plan, ["__len"], "inner", small=True)  # one row per distinct length
    late = F.ceil((F.col("__i") - F.col("__first")) / F.col("__cap"))
    batch = F.col("__batch") + F.when(F.col("__i") <= F.col("__first"), F.lit(0)).otherwise(late)
    return out.withColumn("batch_no", batch.cast("long")).drop("__len", "__i", "__batch", "__first", "__cap")


def pack_padded(df: DataFrame, budget: int, *, length="length", order=("idx",), extra: int = 0) -> DataFrame:
    """A new batch starts when longest * (count + 1) would exceed the budget."""
    sized = df.withColumn("__size", F.col(length) + extra)
    return _pack(sized, "__size", order, _fold_padded(budget)).drop("__size")


def pack_additive(df: DataFrame, budget: int, *, length="length", order=("idx",)) -> DataFrame:
    """A new batch starts when the sum of lengths would exceed the budget."""
    return _pack(df, length, order, _fold_additive(budget))


def _letters(seq: str):
    return F.filter(F.split(seq, ""), lambda c: c != "")


def _counts_by_column(chosen: DataFrame, seq: str):
    """How often each letter stands in each column of the chosen rows, as one value: a map from column to a map of letters."""
    letters = chosen.select(F.posexplode(_letters(seq)).alias("at", "letter")).groupBy("at", "letter").agg(F.count(F.lit(1)).alias("n"))
    columns = letters.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("letter", "n"))).alias("counts"))
    return columns.agg(F.map_from_entries(F.collect_list(F.struct("at", "counts")))).scalar()


def greedy_select(msa: DataFrame, n: int, mode="max", *, idx="rec_idx", seq="sequence") -> DataFrame:
    """Greedy diverse (or similar) subset: first record, then repeatedly the row with the
    largest (smallest) mean Hamming distance to the chosen ones; ties to the first row.

    The distances to all chosen rows come from the letter counts of their columns, so a round is one pass with one
    ``min`` over (score, index), however many are chosen.  Chosen rows are a written table; none comes to the driver.
    """
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    sign = -1.0 if mode == "max" else 1.0
    first = msa.agg(F.min(F.struct(idx, seq)).alias("p")).where("p IS NOT NULL").select("p.*")
    chosen = cut_lineage(first)
    for size in range(1, n):
        counts = F.col("__counts")
        agreeing = F.transform(_letters(seq), lambda c, i: F.coalesce(F.try_element_at(F.try_element_at(counts, i), c), F.lit(0)))
        same = F.aggregate(agreeing, F.lit(0).cast("long"), lambda a, x: a + x)
        apart = (F.length(seq) * size - same) / F.length(seq)
        rest = msa.select(idx, seq).join(chosen.select(idx), idx, "left_anti").withColumn("__counts", _counts_by_column(chosen, seq))
        best = rest.agg(F.min(F.struct((F.round(apart, 9) * sign).alias("s"), F.col(idx).alias("i"), F.col(seq).alias("q"))).alias("p"))
        grown = cut_lineage(chosen.unionAll(best.where("p IS NOT NULL").select("p.i", "p.q")))
        if grown.count() == size:
            break
        chosen = grown
    return msa.join(chosen.select(idx), idx, "left_semi").orderBy(idx)
