"""Tables that end within a structure, and the packed forms beside those over rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from structscreen.bindings import load

SF = "/root/testdata/sf0.001"


def differences(spark, folder, name):
    """Rows of the query and of its SQL over the tables in a folder that the other side lacks."""
    df = load()[name].run(spark, str(folder))
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = os.path.join(folder, t)
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    con.register("mine", df.toArrow())
    con.execute(f"CREATE TABLE sql AS {load()[name].sql}")
    columns = ", ".join(c[0] for c in con.execute("DESCRIBE sql").fetchall())
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM mine")
    return [con.execute(f"FROM (FROM {a} EXCEPT ALL FROM {b}) ORDER BY ALL LIMIT 5").fetchall() for a, b in (("got", "sql"), ("sql", "got"))]


@pytest.fixture
def cut_short(spark, tmp_path):
    """Vectors 0 to 255: the last structure has six atoms and no chain B."""
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 256").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    return tmp_path


def test_load_backbone_of_a_structure_cut_short(spark, cut_short):
    assert differences(spark, cut_short, "load_backbone") == [[], []]


def test_local_frame_of_points_nearly_in_line(spark):
    from structscreen.functions import vec as v

    row = (1.0 + 1e-6, 0.3, 0.0, 0.0, 0.0, 0.0, 0.1, 0.03, 0.0)
    df = spark.createDataFrame([row], ", ".join(f"{p}_{a} double" for p in ("n", "ca", "c") for a in "xyz"))
    got = v.with_local_frame(df, "n_", "ca_", "c_").first()
    assert abs(sum(got["e1_" + a] * got["e2_" + a] for a in "xyz")) < 1e-9


@pytest.mark.parametrize("name", ["sdf_files", "sdf_atoms", "directed_bonds"])
def test_mol_block_cut_short(spark, cut_short, name):
    assert differences(spark, cut_short, name) == [[], []]


def test_chi_angles_of_a_residue_cut_short(spark, cut_short):
    """Vectors 250 to 255 are the first six atoms of an arginine: chi 3, 4 and 5 are unknown."""
    assert differences(spark, cut_short, "side_chain_dihedrals") == [[], []]
    got = load()["side_chain_dihedrals"].run(spark, str(cut_short)).where("resid = 25").orderBy("chi").collect()
    assert [r.angle is None for r in got] == [False, False, True, True, True]


@pytest.mark.parametrize("name", ["drop_short_runs", "fill_gaps", "apply_gap_mask", "trusted_window", "drop_reference_gaps"])
def test_sequences_in_one_row_are_neither_sorted_nor_joined(spark, name):
    assert differences(spark, SF, name) == [[], []]
    plan = load()[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Window", "Sort", "Join", "arrays_zip(filter(split"))


def test_one_row_forms_equal_the_forms_over_rows(spark):
    from structscreen.operators import align as al
    from structscreen.operators import clean as cl

    texts = ["", "E", "AAAA", "AAAAA", "AAAAEAAAEAAAA", "EEAAAAEAAAAAENEAAAE", "AAEAAAEEE", "éééééEééEA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", F.posexplode(al.chars("t")).alias("idx", "c"))
    want = sorted((r.id, r.idx) for r in al.drop_short_runs(rows.where("c <> 'E'")).collect())
    got = df.select("id", F.inline(al.kept_runs("t", "E"))).collect()
    assert sorted((r.id, r.start + i) for r in got for i in range(r.length)) == want

    ali = spark.createDataFrame([(1, "AB-DEF", "ABCDXF"), (2, "A", "B"), (3, "AAAA", "AAAA"), (4, "--AB", "C-AB")], "id int, r string, m string")
    want = sorted(map(tuple, al.trusted_window(al.explode_alignment(ali, ref="r", mod="m"), n=2).collect()))
    assert sorted((r.id, *r.w) for r in ali.select("id", al.trusted_window_of("r", "m", 2).alias("w")).collect()) == want
    assert [tuple(r)[1:] for r in al.drop_ref_gaps(ali, "r", "m").orderBy("id").collect()] == [("ABDEF", "ABDXF"), ("A", "B"), ("AAAA", "AAAA"), ("AB", "AB")]

    models = [[None, 1.0, None, None, 5.5, None], [None], [1.0, 2.5], []]
    df = spark.createDataFrame([(n, [float(i * i) for i in range(len(m))], m) for n, m in enumerate(models)], "id int, x array<double>, m array<double>")
    zero = {c: F.lit(0.0) for c in ("y", "z", "my", "mz")}
    rows = df.select("id", F.posexplode(F.arrays_zip("x", "m")).alias("idx", "v")).select("id", "idx", "v.x", F.col("v.m").alias("mx")).withColumns(zero)
    want = {(r.id, r.idx): r.mx for r in al.fill_gaps(rows, ["id"], idx="idx").collect()}
    got = df.select("id", F.posexplode(al.fill_gaps_in("x", "m")).alias("idx", "v")).collect()
    assert {(r.id, r.idx): r.v for r in got} == pytest.approx(want)

    masks = spark.createDataFrame([(1, [0, 1, 2], "010"), (2, [4], "1")], "id int, r array<long>, mask string")
    assert [r.k for r in masks.orderBy("id").select(cl.gap_mask_kept("r", "mask").alias("k")).collect()] == [[0, 2], []]
    with pytest.raises(Exception, match="differ in length"):
        masks.select(cl.gap_mask_kept("r", F.lit("0"))).collect()


def test_pose_names_are_matched_once(spark):
    from structscreen.sources import tables as ts

    names = ["rank1.sdf", "rank2_ligand_lddt0.50_affinity-1.5_confidence-3.0.sdf", "rank3__lddt.5_affinity1-2.pdb", "rank4_a_lddt1_affinity2_relaxed.sdf", "/5_a_1_2_3",
             "rank6_a_lddt1_affinity2_confidence-.sdf", "rank7_a_lddt1_affinity2.sdf\n", "rank8_a_b_lddt1_affinity2.sdf", None]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    out = ts.parse_pose_filenames(df)
    assert [tuple(r)[1:] for r in out.orderBy("rank").collect()] == [
        (2, "ligand", 0.5, -1.5, -3.0), (3, None, 0.5, None, 0.0), (6, "a", 1.0, 2.0, None), (7, "a", 1.0, 2.0, 0.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan


def test_scores_travel_back_in_one_frame_per_batch(spark):
    import structscreen.streaming.runtime as rt

    class Frame:
        schema = None

        def withColumn(self, *_):
            return self

        def mapInPandas(self, run, schema):
            import pandas as pd

            return list(run([pd.DataFrame({"i": range(100)}), pd.DataFrame({"i": []})]))

    sizes = []
    got = rt.score_complexes(Frame(), lambda pdf: (sizes.append(len(pdf)), pdf)[1], "i int", batch_size=32)
    assert sizes == [32, 32, 32, 4] and [len(f) for f in got] == [100]


def test_larger_cubes_find_the_same_pairs_with_fewer_copies(spark):
    from structscreen.operators import spatial as sp

    place = [(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(40001)) / 1000.0 - 20).alias(c) for c in "xyz"]
    points = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), *place)
    edge = spark.createDataFrame([(9000, 0, 12.0, 0.0, -12.0), (9001, 0, 14.999, 0.0, -12.0), (9002, 0, 12.0, -2.9, -12.0), (9003, 0, None, 0.0, 0.0)], "id long, g long, x double, y double, z double")
    points = points.unionByName(edge)
    one, four = (sorted(map(tuple, sp.radius_pairs(points, 3.0, ["g"], id_col="id", side=s).select("g", "a_id", "b_id").collect())) for s in (1.0, 4.0))
    d2 = " + ".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in "xyz")
    points.createOrReplaceTempView("p3")
    want = spark.sql(f"SELECT a.g, a.id, b.id FROM p3 a JOIN p3 b ON a.g = b.g AND a.id < b.id WHERE {d2} < 9").collect()
    assert one == four == sorted(map(tuple, want)) and (0, 9000, 9001) in four
    copies = [sp._within_reach(points, "xyz", F.lit(3.0), F.lit(3.0 * s), sp._HALF).count() / points.count() for s in (1, 4)]
    assert copies[0] > 12 and copies[1] < 4


def test_lines_are_numbered_over_the_files_of_a_folder(spark, tmp_path):
    from structscreen.bindings.files import _write_lines
    from structscreen.sources import lines as li

    rows = spark.range(5000).select((F.col("id") % 2).alias("no"), "id", F.col("id").alias("line_idx"), F.col("id").cast("string").alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _write_lines(rows, "no", str(tmp_path / "t"), parts=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "t" / "no=1").glob("*.txt"))) > 1
    back = li.with_line_idx(spark, f"{tmp_path}/t/no=*", folders=True)
    assert back.where("line_idx * 2 + cast(regexp_extract(file, 'no=(.)', 1) AS int) <> cast(line AS int)").count() == 0 and back.count() == 5000


def test_batches_and_partitions_are_bounded(spark):
    def size(batches):
        for b in batches:
            yield b.slice(0, 1).select([]).append_column("n", __import__("pyarrow").array([b.num_rows]))

    assert spark.range(5000).coalesce(1).mapInArrow(size, "n long").agg(F.max("n")).first()[0] <= 1000
    exchange = spark.range(100_000).groupBy((F.col("id") % 7).alias("id")).count()._jdf.queryExecution().executedPlan().toString()
    assert ", 400)" in exchange


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_vectors_measure_blocks_and_not_rows(spark, p):
    import numpy as np

    from structscreen.operators import learn as ln

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 8)), np.zeros((30, 8)), np.full((3, 8), 1e6)])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id int, vec array<double>")
    q, pts = (df.select(F.col("id").alias(c), "vec") for c in ("q_id", "p_id"))
    near = ln.knn_vectors(q, pts, 5, p=p, pivots=6, block=20)
    got = {(r.q_id, r.neighbor_rank): (r.p_id, round(r.distance, 5)) for r in near.collect()}
    for i in range(len(x)):
        d = np.abs(x - x[i])
        d = d.sum(axis=1) if p == 1 else np.sqrt((d * d).sum(axis=1))
        best = np.lexsort((np.arange(len(x)), d))[:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, round(d[j], 5)) for j in best], i
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan
