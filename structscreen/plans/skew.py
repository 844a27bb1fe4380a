"""Ordered computations inside groups that may be very large.

A Spark window sorts each group in one task.  That is right for groups that are one thing
(the residues of a structure, the poses of an entry) and wrong for a group that may hold any part
of the table, or for the table as a whole.  Which of the two a group is, the caller knows, so it says so
(``split``; a computation without groups is always split).  Sizes are not looked at while a plan is built.

In the split form every group of more than ``max(minRows, total / 10000)`` rows is cut into consecutive ranges of its
sort order, the window runs per range, and a small table of per-range totals carries the state over
the range borders; all of it is one lazy plan, with the sizes as aggregates inside it.  Results are exactly those of the plain
window.  There are at most 10 000 such groups and 20 000 ranges, whatever the table holds; that is the bound on what is
broadcast.  The borders come from a sample by hash, so they are the same whenever they are computed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ROWS = 2_000_000
MAX_HEAVY = 10_000
_SAMPLES_PER_RANGE = 40
_BLOCK = 64


def attach(left: DataFrame, right: DataFrame, keys, how="left", small=False) -> DataFrame:
    """Null-safe equi-join on equally named keys; the right keys do not stay.

    ``small`` marks a right side whose row count is bounded by construction; only then
    is it broadcast by hint.
    """
    keys = list(keys)
    if not keys:  # the right side is a one-row total of the whole table
        total = right.select(F.struct(*right.columns)).scalar()
        return left.select("*", *[total[c].alias(c) for c in right.columns])
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    if small:
        renamed = F.broadcast(renamed)
    on: Column = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def heavy_groups(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, __n, __ranges) of the groups that are cut, fewer than ``MAX_HEAVY``."""
    least = int(df.sparkSession.conf.get("structscreen.skew.minRows", str(MIN_ROWS)))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    threshold = F.greatest(F.lit(least), F.floor(total / MAX_HEAVY))
    return sizes.where(F.col("__n") > threshold).withColumn("__ranges", F.ceil(F.col("__n") / threshold).cast("int"))


def _window(by, order):
    return Window.partitionBy(*by).orderBy(*[F.col(c).asc() for c in order])


def _plain(spec, w_run, w_all_before, w_back):
    kind = spec[0]
    if kind == "row_number":
        return F.row_number().over(w_run).cast("long")
    value = F.col(spec[1])
    if kind == "sum":
        return F.sum(value).over(w_all_before)
    if kind == "lag":
        return F.lag(value).over(w_run)
    if kind == "lead":
        return F.lead(value).over(w_run)
    if kind == "ffill":
        return F.last(value, ignorenulls=True).over(w_all_before)
    if kind == "bfill":
        return F.last(value, ignorenulls=True).over(w_back)
    raise ValueError(f"unknown running computation {kind!r}")


def _frames(by, order):
    w = _window(by, order)
    return (
        w,
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        # next non-null: the running form over the reversed order; a frame that reaches
        # forward to the end would be evaluated anew for every row
        Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        ),
    )


def over_groups(df: DataFrame, by, order, split: bool = False, **specs) -> DataFrame:
    """Add running columns per group, in ascending order of ``order``.

    Specs: ``("row_number",)``, ``("sum", c)``, ``("lag", c)``, ``("lead", c)``,
    ``("ffill", c)`` (last non-null so far), ``("bfill", c)`` (next non-null).
    ``order`` must identify rows within a group for the result to be determined.
    ``split`` says that a group may hold any part of the table.
    """
    by, order = list(by), list(order)
    if not by:
        return _over_split(df.withColumn("__all", F.lit(1)), ["__all"], order, specs).drop("__all")
    if split:
        return _over_split(df, by, order, specs)
    frames = _frames(by, order)
    return df.withColumns({n: _plain(s, *frames) for n, s in specs.items()})


def _over_split(df, by, order, specs):
    heavy = heavy_groups(df.select(*by), by)
    pos = F.struct(*[F.col(c) for c in order])

    # Split points: a hashed sample of bounded size per heavy group.
    tagged = df.select(*by, *[c for c in order if c not in by])
    sample = (
        attach(tagged, heavy, by, "inner", small=True)  # at most MAX_HEAVY rows
        .where(
            F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.col("__n"))
            < F.col("__ranges") * _SAMPLES_PER_RANGE
        )
    )
    picked = F.expr(
        "transform(sequence(1, __ranges - 1), i -> "
        "element_at(__s, cast(1 + floor(i * size(__s) / __ranges) as int)))"
    )
    bounds = (
        sample.groupBy(*by, "__ranges")
        .agg(F.sort_array(F.collect_list(pos)).alias("__s"))
        .where(F.size("__s") >= F.col("__ranges"))
        .select(*by, picked.alias("__cuts"))
        .withColumn(
            "__coarse",
            F.expr(
                f"transform(sequence(0, cast((size(__cuts) - 1) / {_BLOCK} as int)), "
                f"i -> __cuts[i * {_BLOCK}])"
            ),
        )
    )
    # Range number: block by the coarse cuts, then position inside the block.
    def not_after(cuts):
        return F.size(F.filter(cuts, lambda c: c <= pos))

    block = F.greatest(not_after(F.col("__coarse")) - 1, F.lit(0))
    inside = not_after(F.slice("__cuts", block * _BLOCK + 1, F.lit(_BLOCK)))
    cut = (
        attach(df, bounds, by, small=True)  # at most 2 * MAX_HEAVY split points in all
        .select(
            *df.columns,
            F.when(F.col("__cuts").isNull(), F.lit(-1))
            .otherwise(block * _BLOCK + inside)
            .alias("__range"),
        )
    )

    # Per-range totals of the heavy groups, then the state before/after each range.
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for name, spec in specs.items():
        if spec[0] == "row_number":
            continue
        v = F.col(spec[1])
        if spec[0] == "sum":
            aggs.append(F.sum(v).alias(f"__t_{name}"))
        elif spec[0] == "lag":
            aggs.append(F.max_by(F.struct(v.alias("v")), pos).alias(f"__t_{name}"))
        elif spec[0] == "lead":
            aggs.append(F.min_by(F.struct(v.alias("v")), pos).alias(f"__t_{name}"))
        elif spec[0] == "ffill":
            aggs.append(
                F.max_by(v, F.when(v.isNotNull(), pos)).alias(f"__t_{name}")
            )
        elif spec[0] == "bfill":
            aggs.append(
                F.min_by(v, F.when(v.isNotNull(), pos)).alias(f"__t_{name}")
            )
    totals = cut.where("__range >= 0").groupBy(*by, "__range").agg(*aggs)
    w = Window.partitionBy(*by).orderBy("__range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    carry = {"__c___rows": F.sum("__rows").over(before)}
    for name, spec in specs.items():
        t = f"__t_{name}"
        if spec[0] == "sum":
            carry[f"__c_{name}"] = F.sum(t).over(before)
        elif spec[0] == "lag":
            carry[f"__c_{name}"] = F.lag(t).over(w)
        elif spec[0] == "lead":
            carry[f"__c_{name}"] = F.lead(t).over(w)
        elif spec[0] == "ffill":
            carry[f"__c_{name}"] = F.last(t, ignorenulls=True).over(before)
        elif spec[0] == "bfill":
            carry[f"__c_{name}"] = F.first(t, ignorenulls=True).over(after)
    state = totals.select(*by, "__range", *[c.alias(n) for n, c in carry.items()])

    frames = _frames(by + ["__range"], order)
    local = cut.withColumns({f"__l_{n}": _plain(s, *frames) for n, s in specs.items()})
    local = local.withColumn("__first", F.row_number().over(frames[0]) == 1)
    local = local.withColumn("__last", F.lead(F.lit(1)).over(frames[0]).isNull())
    joined = attach(local, state, by + ["__range"], small=True)  # one row per range
    out = []
    for name, spec in specs.items():
        mine, c = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if spec[0] == "row_number":
            value = mine + F.coalesce(F.col("__c___rows"), F.lit(0))
        elif spec[0] == "sum":
            value = F.when(mine.isNull(), c).when(c.isNull(), mine).otherwise(mine + c)
        elif spec[0] == "lag":
            value = F.when(F.col("__first"), c["v"]).otherwise(mine)
        elif spec[0] == "lead":
            value = F.when(F.col("__last"), c["v"]).otherwise(mine)
        else:
            value = F.coalesce(mine, c)
        out.append(value.alias(name))
    kept = [c for c in df.columns if c not in specs]
    return joined.select(*kept, *out)


def avg_rank(df: DataFrame, by, col: str, out: str, ascending: bool = True, split: bool = False) -> DataFrame:
    """Rank with ties sharing their mean position; null values get a null rank.

    ``split`` says that a group may hold any part of the table; without groups it always does.
    """
    by = list(by)
    signed = "__v"
    value = F.col(col) if ascending else -F.col(col)
    value = F.when(F.isnan(value.cast("double")), None).otherwise(value)
    df = df.withColumn(signed, value)
    if by and not split:
        w_rank = Window.partitionBy(*by).orderBy(F.col(signed).asc_nulls_last())
        w_same = w_rank.rangeBetween(Window.currentRow, Window.currentRow)  # the tied rows
        rank = F.rank().over(w_rank) + (F.count(F.lit(1)).over(w_same) - 1) / F.lit(2.0)
        return df.withColumn(out, F.when(F.col(signed).isNotNull(), rank)).drop(signed)
    # One row per distinct value first: a frequent value is one row, and the running count needs no tie handling.
    # Rows without a value have no rank and do not meet the others.
    distinct = (
        df.where(F.col(signed).isNotNull())
        .groupBy(*by, signed)
        .agg(F.count(F.lit(1)).alias("__same"))
    )
    ranks = over_groups(distinct, by, [signed], split=True, __upto=("sum", "__same")).select(
        *by, signed, (F.col("__upto") - (F.col("__same") - 1) / F.lit(2.0)).alias(out)
    )
    ranked = attach(df.where(F.col(signed).isNotNull()), ranks, by + [signed]).drop(signed)
    return ranked.unionByName(df.where(F.col(signed).isNull()).drop(signed).withColumn(out, F.lit(None).cast("double")))


def checkpoint_folder(spark) -> str:
    """The shared folder the cluster names; a folder of this machine only in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="structscreen-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: it survives the loss of executors.

    Unlike a checkpoint it carries no constraints of the plan behind it; those of an iteration would grow with every round.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
