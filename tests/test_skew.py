"""The split form of ordered computations equals the plain window, group by group."""

import random

import pytest
from pyspark.sql import functions as F

from structscreen.plans.skew import attach, avg_rank, heavy_groups, over_groups

SPECS = dict(n=("row_number",), s=("sum", "v"), lag=("lag", "w"), lead=("lead", "w"), ff=("ffill", "w"), bf=("bfill", "w"))


def table(spark, rows=400):
    rng = random.Random(5)
    data = []
    for i in range(rows):
        g = "hot" if rng.random() < 0.5 else rng.choice("abcdefgh")  # half of the rows share a key
        data.append((g, i * 37 % 1009, rng.randint(0, 5), rng.choice([None, None, rng.randint(0, 99)])))
    return spark.createDataFrame(data, "g string, o long, v long, w long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_split_windows_equal_plain_windows(spark, heavy):
    df = table(spark)
    assert heavy_groups(df.select("g"), ["g"]).count() > 0
    split = over_groups(df, ["g"], ["o"], split=True, **SPECS).select("g", "o", *SPECS)
    plain = over_groups(df, ["g"], ["o"], **SPECS).select("g", "o", *SPECS)
    assert rows(split) == rows(plain)
    spark.conf.unset("structscreen.skew.minRows")
    assert heavy_groups(df.select("g"), ["g"]).count() == 0
    assert rows(over_groups(df, ["g"], ["o"], split=True, **SPECS).select("g", "o", *SPECS)) == rows(plain)
    assert over_groups(df.limit(0), ["g"], ["o"], split=True, **SPECS).count() == 0


def test_split_global_order(spark, heavy):
    df = table(spark)
    out = over_groups(df, [], ["o", "g"], n=("row_number",), s=("sum", "v"))
    got = [tuple(r) for r in out.orderBy("n").select("n", "s", "v").collect()]
    run = 0
    for i, (n, s, v) in enumerate(got, 1):
        run += v
        assert (n, s) == (i, run)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("by,split", [(["g"], False), (["g"], True), ([], False)])
def test_average_rank_with_heavy_group_and_ties(spark, heavy, ascending, by, split):
    df = table(spark)
    got = {(r.g, r.o): r.k for r in avg_rank(df, by, "w", "k", ascending, split).collect()}
    pdf = df.toPandas()
    pdf["k"] = (pdf.groupby("g")["w"] if by else pdf["w"]).rank(ascending=ascending)
    assert len(got) == len(pdf)
    for r in pdf.itertuples():
        k = got[(r.g, r.o)]
        assert (k is None and r.k != r.k) or k == pytest.approx(r.k)


def test_average_rank_plain_form_handles_nan_and_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", float("nan")), ("a", None), ("a", 3.0)], "g string, v double")
    got = sorted((r.k for r in avg_rank(df, ["g"], "v", "k").collect()), key=lambda x: (x is None, x))
    assert got == [1.5, 1.5, 3.0, None, None]


def test_heavy_groups_are_bounded(spark, heavy):
    found = heavy_groups(table(spark).select("g"), ["g"]).collect()
    assert 0 < len(found) <= 10_000 and all(r["__n"] > 7 and r["__ranges"] == -(-r["__n"] // 7) for r in found)


def test_attach_is_null_safe_and_keeps_left_rows(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert rows(attach(a, b, ["k"])) == sorted([(None, 1, 10), ("x", 2, 20), ("y", 3, None)], key=str)


def test_plan_of_small_groups_has_one_exchange(spark):
    df = table(spark)
    plan = over_groups(df, ["g"], ["o"], n=("row_number",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_no_job_runs_while_plans_are_built(spark):
    from structscreen.bindings import load

    ordered = (
        "average_ranks", "all_policies_report", "final_rerank", "compact_ranks", "select_rmsd_combined_rank", "residue_index", "drop_short_runs", "trusted_window", "gap_bounds",
        "drop_reference_gaps", "fill_gaps", "chain_orientations", "backbone_dihedrals", "job_names", "split_80_20", "spearman_per_protein", "validation_metrics_whole_table",
    )
    registry, sc = load(), spark.sparkContext
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for name in ordered:
        sc.setJobGroup(f"plan {name}", "built, not run")
        df = registry[name].run(spark, "/root/testdata/sf0.001")
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"plan {name}") for s in tracker.getJobInfo(j).stageIds]
        sc.setJobGroup("after", "run")
        assert all(s is None or s.name.startswith("parquet at") for s in stages), name  # a table's schema is read by a job of its own
        assert df.count() > 0, name
