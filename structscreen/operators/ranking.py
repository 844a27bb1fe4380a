"""Ranking and selection of poses, run summaries, screening results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structscreen import constants as k
from structscreen.functions.text import draw
from structscreen.plans.skew import attach, avg_rank, over_groups

GROUP = ("entryName", "conformation")

# label of each selection rule, in report order
POLICIES = (
    "by_rank_div5_plus_clash_rank", "by_rank_plus_clash_rank_div2", "by_rank", "by_rmsd",
    "by_clashScore", "random", "rmsd_combined_rank",
)


def frac_below(col: str, limit: float) -> Column:
    """Share of rows below the limit; a missing value counts as not below."""
    return F.avg(F.when(F.col(col) < limit, 1.0).otherwise(0.0))


def weighted_affinity(df: DataFrame, by, *, affinity="affinity", weight="lddt", cap=15.0) -> DataFrame:
    total = F.sum(F.col(affinity) * F.col(weight)) / (F.sum(weight) + F.lit(k.WEIGHT_EPS))
    return df.groupBy(*by).agg(F.least(total, F.lit(float(cap))).alias("affinity"))


def value_counts(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Rows with the size of their key group."""
    return attach(df, df.groupBy(key).agg(F.count(F.lit(1)).alias(out)), [key])


RANKS_USED = {
    "by_rank_div5_plus_clash_rank": {"clash"}, "by_rank_plus_clash_rank_div2": {"clash"},
    "rmsd_combined_rank": {"clash", "affinity"},
}


def with_ranks(poses: DataFrame, by=GROUP, ranks=("affinity", "clash")) -> DataFrame:
    """Average ranks of affinity (high first) and clash score (low first) per group."""
    if "affinity" in ranks:
        poses = avg_rank(poses, by, "affinity", "affinity_rank", ascending=False)
    return avg_rank(poses, by, "clashScore", "clash_rank") if "clash" in ranks else poses


def policy_score(policy: str, seed: int, draw_keys) -> Column:
    rank, clash, aff = F.col("rank"), F.col("clash_rank"), F.col("affinity_rank")
    # rounded to nine digits so that the engine's order of additions cannot break ties
    if policy == "by_rank_div5_plus_clash_rank":
        return F.round(rank / 5 + clash, 9)
    if policy == "by_rank_plus_clash_rank_div2":
        return F.round(rank + clash / 2, 9)
    if policy == "rmsd_combined_rank":
        return F.round(rank + aff / 3 + clash, 9)
    if policy == "by_rank":
        return rank.cast("double")
    if policy == "by_rmsd":
        return F.col("rmsd")
    if policy == "by_clashScore":
        return F.col("clashScore")
    if policy == "random":
        return draw(seed, *[F.col(c) for c in draw_keys]).cast("double")
    raise ValueError(f"unknown selection policy {policy!r}")


def without_failed(poses: DataFrame, legacy_sentinel=False) -> DataFrame:
    """A clash score of -1 means failure and must not win; NaN is no value."""
    value = F.col("clashScore")
    good = F.when(~F.isnan(value), value)
    if not legacy_sentinel:
        good = F.when(good != -1, good)
    return poses.withColumn("clashScore", good)


def select_policies(
    poses: DataFrame, policies=POLICIES, by=GROUP, *, tie, draw_keys=None, seed=7, keep=None,
    legacy_sentinel=False,
) -> DataFrame:
    """Best pose per group under each policy, all policies in one grouped pass.

    Each policy is one ``min`` over (score, tie, row) structs, so the partial aggregates
    run before the shuffle and no group is ever sorted or gathered.  ``tie`` must tell the
    rows of a group apart; ``draw_keys`` are the integer keys of the random policy
    (``tie`` by default).
    """
    by, tie = list(by), list(tie)
    keep = list(keep or [c for c in poses.columns if c not in by])
    needed = set().union(*[RANKS_USED.get(p, set()) for p in policies])
    ranked = with_ranks(without_failed(poses, legacy_sentinel), by, needed)
    best = []
    for p in policies:
        score = policy_score(p, seed, draw_keys or tie)
        order = F.struct(score.isNull().alias("no_score"), score.alias("score"), *[F.col(c).alias(f"t_{c}") for c in tie])
        best.append(F.min(F.struct(order.alias("o"), F.struct(*keep).alias("row"))).alias(p))
    chosen = ranked.groupBy(*by).agg(*best)
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("policy_no"), F.lit(p).alias("selection"), F.col(p)["row"].alias("row"))
        for i, p in enumerate(policies)
    ]))
    return chosen.select(*by, rows.alias("p")).select(*by, "p.policy_no", "p.selection", "p.row.*")


def select_poses(poses: DataFrame, policy: str, by=GROUP, *, tie, **options) -> DataFrame:
    return select_policies(poses, (policy,), by, tie=tie, **options).drop("policy_no")


def summarize(poses: DataFrame, extra=()) -> DataFrame:
    """Run summary: clash mean per (conformation, dataset), the rest per conformation."""
    extra = list(extra)
    per_run = poses.groupBy(*extra, "conformation").agg(
        frac_below("rmsd", 2).alias("below2A"), frac_below("rmsd", 5).alias("below5A"),
        F.avg("pocket_rmsd").alias("pocket_rmsd"), F.count(F.lit(1)).alias("n_entries"),
    )
    per_set = poses.groupBy(*extra, "conformation", "dataset_name").agg(F.avg("clashScore").alias("clashScore"))
    return attach(per_set, per_run, [*extra, "conformation"], "inner")


def show_all_metrics(poses: DataFrame, *, tie, draw_keys=None, seed=7, by=GROUP) -> DataFrame:
    """Summary of every selection policy, labelled and numbered in report order."""
    chosen = select_policies(poses, by=by, tie=tie, draw_keys=draw_keys, seed=seed, keep=["dataset_name", "clashScore", "rmsd", "pocket_rmsd"])
    return summarize(chosen, ["policy_no", "selection"])


def rounded(df: DataFrame, digits=3) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


def rerank(poses: DataFrame, by, *, tie, score="lddt", clash="clashScore") -> DataFrame:
    """Final rank from average ranks: confidence (high first) plus half the clash rank."""
    by = list(by)
    out = avg_rank(poses, by, score, "__s", ascending=False)
    out = avg_rank(out, by, clash, "__c")
    out = out.withColumn("__o", F.round(F.col("__s") + F.col("__c") / 2, 9))
    return over_groups(out, by, ["__o", *tie], final_rank=("row_number",)).drop("__s", "__c", "__o")


def compact_ranks(poses: DataFrame, by, rank="rank", tie=()) -> DataFrame:
    return over_groups(poses, by, [rank, *tie], new_rank=("row_number",))


def top_poses(poses: DataFrame, n: int, by=GROUP, *, order=("rank",)) -> DataFrame:
    """First n rows per group; each map task already drops rows beyond n per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return poses.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def accept_poses(df: DataFrame, *, protein="protein_violations", ligand="ligand_violations", energy="energy", limit=1000.0) -> DataFrame:
    bad = (F.col(protein) > 0) | (F.col(ligand) > 0) | (F.col(energy) > limit)
    return df.withColumn("accepted", ~F.coalesce(bad, F.lit(False)))


def sample_one(df: DataFrame, by, *, keys, seed: int) -> DataFrame:
    """One row per group by a reproducible draw; ties go to the smaller keys."""
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    pick = F.min(F.struct(draw(seed, *[F.col(c) for c in keys]).alias("d"), *[F.col(c).alias(f"k_{c}") for c in keys], F.struct(*rest).alias("row")))
    return df.groupBy(*by).agg(pick.alias("p")).select(*by, "p.row.*")


def failure_report(df: DataFrame, status="status", by=()) -> DataFrame:
    return df.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------------- screening
def merge_screening(inputs: DataFrame, preds: DataFrame) -> DataFrame:
    """Predictions named idx_k joined to row k of the input of the same batch."""
    renamed = preds.select(
        "batch", F.get(F.split("name", "_"), F.lit(1)).try_cast("long").alias("row_idx"),
        F.col("affinity").alias("affinity_pred"), F.col("name"),
    )
    if "name" in inputs.columns:
        renamed = renamed.drop("name")
    return inputs.join(renamed, ["batch", "row_idx"], "inner")


def with_job_name(df: DataFrame, order, by=()) -> DataFrame:
    """Surrogate key idx_<i> in the given order, i from 0."""
    out = over_groups(df, list(by), list(order), row_idx=("row_number",))
    out = out.withColumn("row_idx", F.col("row_idx") - 1)
    return out.withColumn("name", F.concat(F.lit("idx_"), F.col("row_idx").cast("string")))
