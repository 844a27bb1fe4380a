import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from structscreen.functions import vec as v
from structscreen.operators import lddt as ld
from structscreen.operators import rigid as rg
from structscreen.operators import spatial as sp
from structscreen.operators import structure as st


def cloud(spark, n=120, groups=2, seed=1, size=12.0, duplicates=True):
    rng = random.Random(seed)
    data = []
    for g in range(groups):
        for i in range(n):
            data.append((g, i, *[rng.uniform(-size, size) for _ in range(3)]))
        if duplicates:  # points on the same place, and one far away
            data += [(g, n + j, 1.0, 1.0, 1.0) for j in range(6)] + [(g, n + 50, 500.0, -500.0, 3.0)]
    return spark.createDataFrame(data, "g int, idx long, x double, y double, z double")


def brute(df, radius, strict=True):
    pts = {}
    for r in df.collect():
        pts.setdefault(r.g, []).append((r.idx, np.array([r.x, r.y, r.z])))
    out = set()
    for g, p in pts.items():
        for i, a in p:
            for j, b in p:
                d = np.linalg.norm(a - b)
                if i < j and (d < radius if strict else d <= radius):
                    out.add((g, i, j))
    return out


@pytest.mark.parametrize("radius", [0.5, 3.0, 40.0])
def test_grid_pairs_equal_brute_force(spark, radius):
    df = cloud(spark)
    got = {(r.g, r.a_idx, r.b_idx) for r in sp.radius_pairs(df, radius, ["g"], id_col="idx").collect()}
    assert got == brute(df, radius)


def test_strict_and_not_strict_edges(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 2.0, 0.0, 0.0)], "g int, idx long, x double, y double, z double")
    assert sp.radius_pairs(df, 2.0, ["g"], id_col="idx").count() == 0
    assert sp.radius_pairs(df, 2.0, ["g"], id_col="idx", strict=False).count() == 1


def test_no_cartesian_or_nested_loop_join(spark):
    df = cloud(spark)
    for out in (
        sp.radius_pairs(df, 3.0, ["g"], id_col="idx"), sp.radius_join(df, df, 3.0, ["g"], a_cols=["idx"]),
        sp.knn_join(df, df, 3, ["g"], q_id="idx", p_id="idx"),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("k", [1, 4, 200])
def test_nearest_neighbours_are_exact(spark, k):
    df = cloud(spark, n=60)
    got = {}
    for r in sp.knn_join(df, df, k, ["g"], q_id="idx", p_id="idx", exclude_same_id=True).collect():
        got.setdefault((r.g, r.a_idx), []).append((round(r.distance, 9), r.b_idx))
    pts = {}
    for r in df.collect():
        pts.setdefault(r.g, []).append((r.idx, np.array([r.x, r.y, r.z])))
    for g, p in pts.items():
        for i, a in p:
            want = sorted((round(float(np.linalg.norm(a - b)), 9), j) for j, b in p if j != i)[:k]
            assert sorted(got[(g, i)]) == want


def test_isolated_point_fails_the_job(spark):
    df = cloud(spark)
    graph = sp.neighbor_graph(df, 6.0, 5, ["g"], id_col="idx")
    with pytest.raises(Exception, match="isolated point"):
        graph.count()
    near = df.where("x < 400")
    assert sp.neighbor_graph(near, 30.0, 5, ["g"], id_col="idx").count() == near.count() * 5


def test_tiered_neighbours(spark):
    pos = [(p, None if p % 3 == 0 else float(p)) for p in range(12)]
    df = spark.createDataFrame([(1, p, x, 0.0, 0.0) for p, x in pos], "g int, pos long, x double, y double, z double")
    got = {}
    for r in sp.knn_tiered(df, 10, ["g"]).orderBy("i", "neighbor_rank").collect():
        got.setdefault(r.i, []).append((r.j, r.has_coordinates))
    for i, xi in pos:
        def cost(j, xj):
            return math.sqrt((xi - xj) ** 2 + 1e-8) if xi is not None and xj is not None else 1e8 + abs(i - j) * 1e6
        want = sorted((cost(j, xj), j) for j, xj in pos)[:10]
        assert got[i] == [(j, c < 5e7) for c, j in want]


def turned(df, prefix=""):
    r = v.matrix_from_axis_angle((F.lit(0.5), F.lit(-1.2), F.lit(0.8)))
    p = v.vec(prefix)
    moved = v.add(v.matrix_times_column(r, p), (F.lit(7.0), F.lit(-3.0), F.lit(11.0)))
    staged = df.select("*", *[m.alias(f"__{c}") for c, m in zip("xyz", moved)])
    return staged.select(*[c for c in df.columns if c not in {prefix + a for a in "xyz"}], *[F.col(f"__{c}").alias(prefix + c) for c in "xyz"])


def test_distance_operators_do_not_see_rotation(spark):
    df = cloud(spark, duplicates=False)
    a = sp.radius_pairs(df, 5.0, ["g"], id_col="idx").select("g", "a_idx", "b_idx")
    b = sp.radius_pairs(turned(df), 5.0, ["g"], id_col="idx").select("g", "a_idx", "b_idx")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_kabsch_recovers_a_known_motion(spark):
    df = cloud(spark, duplicates=False)
    moved = turned(df).select("g", "idx", *[F.col(c).alias("b_" + c) for c in "xyz"])
    pairs = df.select("g", "idx", *[F.col(c).alias("a_" + c) for c in "xyz"]).join(moved, ["g", "idx"])
    fits = rg.kabsch(pairs, ["g"])
    for r in fits.collect():
        assert r.rmsd < 1e-5 and r.t == pytest.approx([7.0, -3.0, 11.0], abs=1e-9)
        m = np.array(r.r).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1.0)
    back = rg.apply_transform(df, fits, ["g"]).join(moved, ["g", "idx"])
    assert back.agg(F.max(v.dist(v.vec(), v.vec("b_")))).first()[0] < 1e-9


def test_kabsch_reflection_repair(spark):
    df = cloud(spark, duplicates=False).select("g", "idx", *[F.col(c).alias("a_" + c) for c in "xyz"], F.col("x").alias("b_x"), F.col("y").alias("b_y"), (-F.col("z")).alias("b_z"))
    det = [np.linalg.det(np.array(r.r).reshape(3, 3)) for r in rg.kabsch(df, ["g"]).collect()]
    assert det == pytest.approx([1.0, 1.0])
    assert all(r.rmsd < 1e-5 for r in rg.kabsch_rmsd(df, ["g"]).collect())  # unrepaired fit mirrors


def lddt_atoms(df, shift="x"):
    amb = F.when(F.col("idx") % 10 == 2, 1).when(F.col("idx") % 10 == 7, 2).otherwise(0)
    return df.select("g", F.col("idx").alias("atom_idx"), F.floor(F.col("idx") / 10).alias("res_idx"), amb.alias("amb"),
                     *[F.col(c).alias("r" + c) for c in "xyz"], *[F.col(c).alias("m" + c) for c in "xyz"])


def test_lddt_of_itself_is_one_and_ignores_motion(spark):
    atoms = lddt_atoms(cloud(spark, duplicates=False))
    ligand = cloud(spark, n=10, seed=9, duplicates=False)
    for table, lig in ((atoms, ligand), (turned(atoms, "m"), turned(ligand))):
        for r in ld.lddt(table, ["g"], ligand=lig, cutoff=6.0).collect():
            assert r.lddt == 1.0 and r.bs_total > 0 and r.bs_lddt == pytest.approx(1.0, abs=1e-4)
        per = ld.lddt_per_residue(table, ["g"])
        assert per.where("score <> 1.0").count() == 0


def test_lddt_swaps_exchanged_symmetric_atoms(spark):
    atoms = lddt_atoms(cloud(spark, duplicates=False))
    swapped = atoms.alias("a").join(
        atoms.where("amb > 0").select("g", F.when(F.col("amb") == 1, F.col("atom_idx") + 5).otherwise(F.col("atom_idx") - 5).alias("atom_idx"), *[F.col("m" + c).alias("o" + c) for c in "xyz"]),
        ["g", "atom_idx"], "left",
    ).withColumns({f"m{c}": F.coalesce(f"o{c}", f"m{c}") for c in "xyz"}).drop("ox", "oy", "oz")
    assert [r.lddt for r in ld.lddt(swapped, ["g"]).collect()] == [1.0, 1.0]
    assert all(r.lddt < 1.0 for r in ld.lddt(swapped, ["g"], resolve=False).collect())


def test_lddt_without_near_atoms_is_zero(spark):
    far = spark.createDataFrame([(0, 999.0, 0.0, 0.0), (1, 999.0, 0.0, 0.0)], "g int, x double, y double, z double")
    for r in ld.lddt(lddt_atoms(cloud(spark, duplicates=False)), ["g"], ligand=far).collect():
        assert r.bs_lddt == 0 and r.bs_total == 0


def two_chains(spark, n=60, seed=2):
    """Reference and model atoms by name: chain A is scored, chain B comes later."""
    rows = [(g, i, "A" if i < n else "B", (i % n) // 10, "PHE" if (i % n) // 10 % 2 else "ALA", ["X0", "X1", "CD1", "CE1", "X4", "X5", "X6", "CD2", "CE2", "X9"][i % 10], i) for g in range(2) for i in range(2 * n)]
    rng = random.Random(seed)
    placed = [(*r, *[rng.uniform(-6, 6) for _ in range(3)]) for r in rows]
    return spark.createDataFrame(placed, "target int, line_idx int, chain string, residue_idx int, resname string, atom_name string, k int, x double, y double, z double")


def brute_lddt(ref, model, radius):
    """Score of one model by the definition: symmetric residues choose first, then all pairs are counted."""
    kept = lambda a, b, ra, rb: sum(abs(np.linalg.norm(a - b) - np.linalg.norm(ra - rb)) <= t for t in (0.5, 1, 2, 4))
    near = lambda a, b: a[0] != b[0] and np.linalg.norm(ref[a][0] - ref[b][0]) < radius
    both = [a for a in ref if a in model]
    chosen = dict(model)
    for res in {a[0] for a in both}:
        own = [a for a in both if a[0] == res and ref[a][1]]
        one, two = ([a for a in sorted(own) if ref[a][1] == c] for c in (1, 2))
        if not one or len(one) != len(two):
            continue
        other = dict(zip(one, two)) | dict(zip(two, one))
        plain = [b for b in both if not ref[b][1]]
        score = [sum(kept(model[t], model[b], ref[a][0], ref[b][0]) for a, t in names for b in plain if near(a, b)) for names in ([(a, a) for a in own], list(other.items()))]
        if score[1] > score[0]:
            chosen |= {a: model[t] for a, t in other.items()}
    pairs = [(a, b) for a in both for b in both if a < b and near(a, b)]
    return sum(kept(chosen[a], chosen[b], ref[a][0], ref[b][0]) for a, b in pairs), 4 * len(pairs)


def test_lddt_of_many_models_from_atom_tables(spark):
    ref = two_chains(spark)
    poses = F.explode(F.sequence(F.lit(0), F.lit(70)))  # more than one block of models
    jitter = lambda c, k: F.col(c) + F.sin(F.col("k") * k + F.col("pose") * 3) * F.col("pose") / 25
    model = ref.withColumn("pose", poses).where((F.col("k") + F.col("pose")) % 13 != 0)
    swap = F.when((F.col("pose") % 2 == 0) & (F.col("atom_name") == "CD1"), "CD2").when((F.col("pose") % 2 == 0) & (F.col("atom_name") == "CD2"), "CD1").otherwise(F.col("atom_name"))
    model = model.select("target", "pose", "line_idx", "chain", "residue_idx", swap.alias("atom_name"), *[jitter(c, n).alias(c) for n, c in enumerate("xyz", 1)])
    atoms = ld.lddt_input(ref, model)
    got = {(r.target, r.pose): r for r in ld.lddt_of_models(atoms, radius=8.0).collect()}
    assert len(got) == 2 * 71
    amb = {"CD1": 1, "CE1": 1, "CD2": 2, "CE2": 2}
    refs, models = {}, {}
    for r in ref.where("chain = 'A'").collect():
        refs.setdefault(r.target, {})[r.residue_idx, r.atom_name] = (np.array([r.x, r.y, r.z]), amb.get(r.atom_name, 0) if r.resname == "PHE" else 0)
    for r in model.where("chain = 'A' AND pose IN (0, 1, 2, 33, 64, 70)").collect():
        models.setdefault((r.target, r.pose), {})[r.residue_idx, r.atom_name] = np.array([r.x, r.y, r.z])
    for key, places in models.items():
        assert (got[key].conserved_distances, got[key].total_n_distances) == brute_lddt(refs[key[0]], places, 8.0), key
    placed = ld._places(atoms.withColumn("id", F.struct("res_idx", "atom")), ["target", "pose"], "res_idx", "id", None, 0.0, True)
    few = ld._blocks(placed.where("pose < 3"), ["target"], ["pose"], "res_idx", "id")[0].count()
    assert few == ld._blocks(placed.where("pose < 60"), ["target"], ["pose"], "res_idx", "id")[0].count() == 120  # pairs are searched among as many points


def test_clash_radii_are_case_sensitive_and_groups_without_pairs_stay(spark):
    protein = spark.createDataFrame([("a", "CL", 0.0), ("a", "H", 1.0), ("b", "C", 900.0)], "pose_id string, element string, x double").selectExpr("*", "0D AS y", "0D AS z")
    ligand = spark.createDataFrame([("a", "Cl", 3.0), ("b", "C", 0.0)], "pose_id string, symbol string, x double").selectExpr("*", "0D AS y", "0D AS z")
    out = {r.pose_id: r for r in st.clash_score(protein, ligand).collect()}
    assert out["a"].overlap_mean == pytest.approx(2.0 + 1.75 - 3.0) and (out["a"].clash_n, out["a"].n) == (1, 1)
    assert (out["b"].clashScore, out["b"].n) == (0.0, 0)


def test_pocket_rmsd_without_near_atom(spark):
    pairs = cloud(spark, duplicates=False).select("g", F.col("idx").alias("atom_idx"), *[F.col(c).alias("a_" + c) for c in "xyz"], (F.col("x") + 1).alias("b_x"), F.col("y").alias("b_y"), F.col("z").alias("b_z"))
    far = spark.createDataFrame([(0, 999.0, 0.0, 0.0)], "g int, x double, y double, z double")
    for r in rg.protein_rmsd(pairs, far, ["g"]).collect():
        assert r.protein_rmsd == pytest.approx(1.0) and r.pocket_rmsd == -1.0


def test_pockets_keep_chains_and_structures_apart(spark):
    from structscreen.operators import clean as cl

    atoms = spark.createDataFrame([
        ("s", "A", 7, " ", "ATOM", 100.0, 0.0, 0.0), ("s", "B", 7, " ", "ATOM", 0.0, 0.0, 0.0), ("s", "A", 8, " ", "ATOM", 1.0, 0.0, 0.0),
        ("s", "A", 9, " ", "HETATM", 1.0, 1.0, 0.0), ("t", "A", 7, " ", "ATOM", 0.0, 0.0, 0.0),
    ], "structure_id string, chain string, resid int, insertion string, record string, x double, y double, z double")
    centre = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0)], "structure_id string, pocket_rank int, center_x double, center_y double, center_z double")
    got = sp.extract_pockets(atoms, atoms, centre, 5.0)
    assert [(r.structure_id, r.chain, r.resid) for r in got.collect()] == [("s", "A", 8)]
    kept = cl.keep_residues(atoms, atoms.where("structure_id = 't'"))
    assert [(r.structure_id, r.resid) for r in kept.collect()] == [("t", 7)]


def test_missing_chain_is_checked_per_structure(spark):
    from structscreen.operators import clean as cl

    atoms = spark.createDataFrame([("s", "A", "CA", " "), ("t", "B", "CA", " "), ("t", "A", "N", " ")], "structure_id string, chain string, atom_name string, hetero string")
    with pytest.raises(Exception, match="chain not found: B in s"):
        cl.load_backbone(atoms, chains=["A", "B"]).collect()
    assert cl.load_backbone(atoms, chains=["A"]).count() == 2


def test_positions_with_gaps_and_empty_ranges_and_null_elements(spark):
    from structscreen.operators import clean as cl
    from structscreen.operators import structure as st

    res = spark.createDataFrame([("g", p, None if p == 10 else float(p), 0.0, 0.0) for p in (1, 5, 10, 15, 20)], "g string, pos long, x double, y double, z double")
    lost = [r for r in sp.knn_tiered(res, 3, ["g"]).collect() if r.i == 10]
    assert sorted(r.j for r in lost) == [5, 10, 15]
    pred = spark.createDataFrame([("p", 0, 4, 0.9, 1)], "structure_id string, i int, j int, score double, target int")
    lengths = spark.createDataFrame([("p", 10), ("q", 10)], "structure_id string, length int")
    got = {(r.structure_id, r.contact_range): r.p_at_l for r in st.contact_precision(pred, lengths).collect()}
    assert len(got) == 8 and got[("p", "local")] == pytest.approx(0.1) and got[("q", "long")] == 0.0
    plain = spark.createDataFrame([(None, "CA"), ("H", "HA"), ("C", "CB")], "element string, atom_name string")
    assert cl.drop_elements(plain).count() == 2


def test_rotation_from_axis_angle(spark):
    from structscreen.functions import vec as v

    rows = [(0.0, 0.0, 0.0), (1e-9, 0.0, 0.0), (0.3, -0.2, 0.9), (0.0, 0.0, math.pi), (1e-4, 2e-4, -1e-4)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    m = df.select("x", "y", "z", v.matrix_from_axis_angle(v.vec()).alias("m")).collect()
    for r in m:
        w = np.array([[0, -r.z, r.y], [r.z, 0, -r.x], [-r.y, r.x, 0]])
        want, term = np.eye(3), np.eye(3)
        for k in range(1, 40):
            term = term @ w / k
            want = want + term
        np.testing.assert_allclose(np.array(r.m).reshape(3, 3), want, atol=1e-12)


def nearest_by_hand(points, queries, k, same):
    out = {}
    for q, a in queries.items():
        near = sorted((math.dist(a, b), p) for p, b in points.items() if not same or p != q)[:k]
        out[q] = [p for _, p in near]
    return out


@pytest.mark.parametrize("pieces", ["1", "40"])
def test_neighbors_of_a_crowd_with_far_outliers(spark, pieces):
    rng = random.Random(7)
    points = {i: tuple(rng.gauss(1000, 1) for _ in range(3)) for i in range(900)}
    points |= {1000 + i: tuple(rng.gauss(1000, 1e-6) for _ in range(3)) for i in range(60)}  # a crowd within the crowd
    points |= {2000: (1e9, -1e9, 3.0), 2001: (1e9, -1e9, 4.0), 2002: (-1e9, 0.0, 0.0)}
    points |= {3000 + i: (999.0, 1000.0, 1001.0) for i in range(20)}  # one place
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "idx long, x double, y double, z double")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    try:
        got = {}
        for r in sp.knn_join(df, df, 5, q_id="idx", p_id="idx", exclude_same_id=True).collect():
            got.setdefault(r.a_idx, {})[r.neighbor_rank] = r.b_idx
        want = nearest_by_hand(points, points, 5, True)
        assert {q: [n[i] for i in range(1, 6)] for q, n in got.items()} == want
        tried = sp.knn_candidates(df, df, 5, (), q_id="idx", p_id="idx", exclude_same_id=True)
        sizes = {r["__q"]: r["n"] for r in tried.groupBy("__q").agg(F.count(F.lit(1)).alias("n")).collect()}
        in_crowd = sorted(n for q, n in sizes.items() if q < 900)
        if pieces == "1":  # a border of pieces can cost its neighbours a wider search
            assert in_crowd[len(in_crowd) // 2] < 400 and sum(sizes[i] for i in range(1000, 1060)) / 60 < 100
        far = {5000: (5e8, 5e8, 5e8), 5001: (1000.0, 1000.0, 1000.0)}
        asked = spark.createDataFrame([(i, *p) for i, p in far.items()], "q long, x double, y double, z double")
        found = {}
        for r in sp.knn_join(asked, df, 3, q_id="q", p_id="idx").collect():
            found.setdefault(r.a_q, {})[r.neighbor_rank] = r.b_idx
        assert {q: [n[i] for i in (1, 2, 3)] for q, n in found.items()} == nearest_by_hand(points, far, 3, False)
        assert sp.knn_join(asked, df.limit(0), 3, q_id="q", p_id="idx").count() == 0
        assert sp.knn_join(asked.limit(0), df, 3, q_id="q", p_id="idx").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
