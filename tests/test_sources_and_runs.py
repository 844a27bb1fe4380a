"""Readers, writers, user functions and streams on small files."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from structscreen.operators import clean as cl
from structscreen.operators import graph as gr
from structscreen.operators import learn as ln
from structscreen.operators import ranking as rk
from structscreen.sources import fasta as fa
from structscreen.sources import lines as li
from structscreen.sources import pdb
from structscreen.sources import tables as ts
from structscreen.streaming import incremental as inc
from structscreen.streaming import runtime as rt

PDB = """HEADER    TEST
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 20.00           N
ATOM      2  CA AALA A   1      11.639   6.071  -5.147  0.50 30.00           C
ATOM      3  CA BALA A   1      11.700   6.100  -5.200  0.50 30.00           C
ATOM      4  C   ALA A   1      10.560   5.700  -4.140  1.00 40.00           C
HETATM    5 SE   MSE A   2       9.000   5.000  -4.000  1.00 10.00          SE
HETATM    6  O   HOH A 301       1.000   2.000   3.000  1.00 50.00           O
END
"""


def test_pdb_read_clean_write_read(spark, tmp_path):
    (tmp_path / "one.pdb").write_text(PDB)
    atoms = pdb.read_pdb(spark, str(tmp_path / "one.pdb"), id_pattern=li.STEM)
    assert atoms.count() == 6 and {r.structure_id for r in atoms.collect()} == {"one"}
    kept = cl.clean_atoms(atoms)
    assert sorted(r.atom_number for r in kept.collect()) == [1, 2, 4, 5]
    out = tmp_path / "out"
    pdb.write_pdb(kept, str(out))
    back = pdb.parse_atom_lines(li.with_line_idx(spark, f"{out}/structure_id=one/*.txt"))
    cols = ["atom_number", "atom_name", "altloc", "resname", "chain", "resid", "x", "y", "z", "occupancy", "b_factor", "element"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, kept.select(cols).collect()))
    assert li.with_line_idx(spark, f"{out}/structure_id=one/*.txt").where("line LIKE 'ATOM%' AND length(line) <> 80").count() == 0


def test_lines_are_numbered_over_splits_and_folders(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        want = {}
        for folder in ("a", "b"):  # equal names in two folders stay apart
            (tmp_path / folder).mkdir()
            lines = [f"{folder} line {i}" * (i % 4) for i in range(200)]
            (tmp_path / folder / "x.txt").write_text("\r\n".join(lines) + "\n")
            want |= {(folder, i): line for i, line in enumerate(lines)}
        rows = li.with_line_idx(spark, f"{tmp_path}/*/x.txt").collect()
        assert {(r.file.split("/")[-2], r.line_idx): r.line for r in rows} == want and len(rows) == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fasta_labels_and_duplicates(spark, tmp_path):
    f = tmp_path / "s.fasta"
    f.write_text(">a one\nMK\n TV \n>\nAAA\nCC\n>b\n\n")
    got = [(r.rec_idx, r.label, r.sequence) for r in fa.read_fasta(spark, str(f)).orderBy("rec_idx").collect()]
    assert got == [(0, "a one", "MKTV"), (1, "seqnum000000003", "AAACC"), (2, "b", "")]
    f.write_text(">a\nMK\n>a\nAA\n")
    with pytest.raises(Exception, match="duplicate sequence label"):
        fa.read_fasta(spark, str(f)).count()
    assert fa.read_msa(spark, str(f), nseq=1).count() == 1


def test_fasta_write_and_read_back(spark, tmp_path):
    seqs = spark.createDataFrame([("x", "MKT"), ("y", "A")], "label string, sequence string")
    fa.write_fasta(seqs.coalesce(1), str(tmp_path / "out"))
    back = fa.read_fasta(spark, str(tmp_path / "out")).select("label", "sequence")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, seqs.collect()))


def test_ragged_alignment_is_an_error(spark):
    bad = spark.createDataFrame([("m", "AC"), ("m", "A")], "msa_id string, sequence string")
    with pytest.raises(Exception, match="differ in length"):
        fa.check_equal_length(bad).collect()


def test_job_table_columns(spark, tmp_path):
    f = tmp_path / "jobs.csv"
    f.write_text(" protein_path , ligand,gap_mask\np.pdb,CCO,0010\n")
    df = ts.read_jobs(spark, str(f))
    assert df.columns == ["protein_path", "ligand", "gap_mask"] and df.first().gap_mask == "0010"
    with pytest.raises(ValueError, match="crystal_protein_path"):
        ts.read_jobs(spark, str(f), required=("crystal_protein_path",))


def test_prediction_sinks(spark, tmp_path):
    summary = spark.createDataFrame([("idx_0", 5.0)], "name string, affinity double")
    complete = spark.createDataFrame([("idx_0", 0.5, 5.0)], "name string, lddt double, affinity double")
    ts.write_predictions(summary, complete, str(tmp_path / "b1"))
    back = spark.read.csv(str(tmp_path / "b1" / "complete_affinity_prediction"), header=True)
    assert back.columns == ["name", "rank", "lddt", "affinity"] and back.first()["rank"] is None


def test_gap_mask_of_wrong_length_fails(spark):
    res = spark.createDataFrame([("s", 0), ("s", 1)], "structure_id string, residue_idx long")
    mask = spark.createDataFrame([("s", "011")], "structure_id string, gap_mask string")
    with pytest.raises(Exception, match="differ in length"):
        cl.apply_gap_mask(res, mask).count()


def test_missing_chain_fails(spark, tmp_path):
    (tmp_path / "one.pdb").write_text(PDB)
    atoms = pdb.read_pdb(spark, str(tmp_path / "one.pdb"))
    assert cl.load_backbone(atoms, chains=["A"]).count() == 4
    with pytest.raises(Exception, match="chain not found: Z"):
        cl.load_backbone(atoms, chains=["A", "Z"]).count()


def test_failed_clash_never_wins(spark):
    poses = spark.createDataFrame(
        [("e", "c", 1, -1.0, 1.0, 0), ("e", "c", 2, 0.2, 2.0, 1)], "entryName string, conformation string, rank int, clashScore double, affinity double, k int"
    ).withColumns({"rmsd": F.lit(1.0), "pocket_rmsd": F.lit(1.0), "dataset_name": F.lit("d")})
    assert rk.select_poses(poses, "by_clashScore", tie=["k"]).first()["rank"] == 2
    assert rk.select_poses(poses, "by_clashScore", tie=["k"], legacy_sentinel=True).first()["rank"] == 1


def test_rotatable_bonds_of_a_ring_with_two_tails(spark):
    # ring 0-1-2-3, tail 3-4-5-6 and single atom 7 on 0
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (5, 6), (0, 7)]
    bonds = spark.createDataFrame([("m", a, b, 2 if (a, b) == (4, 5) else 1, i) for i, (a, b) in enumerate(edges)], "mol_id string, a int, b int, bond_type int, bond_idx int")
    rot = gr.rotatable_bonds(bonds)
    assert {(r.parent, r.atom, r.smaller) for r in rot.collect()} == {(3, 4, 3)}  # 4=5 is double, 5-6 and 0-7 end in one atom
    assert {(r.src, r.dst, r.atom) for r in gr.rotation_masks(bonds).collect()} == {(3, 4, a) for a in (4, 5, 6)}
    t = gr.torsion_atoms(bonds, rot).first()
    assert (t.before, t.start, t.end, t.after) == (2, 3, 4, 5)


def split_by_hand(edges):
    """Bonds that split a connected molecule, with the side of each that lacks the smallest atom."""
    out = {}
    for cut in edges:
        near = {}
        for e in edges:
            if e != cut:
                for a, b in (e, e[::-1]):
                    near.setdefault(a, []).append(b)
        seen, open_ = {min(x for e in edges for x in e)}, [min(x for e in edges for x in e)]
        while open_:
            for b in near.get(open_.pop(), []):
                if b not in seen:
                    seen.add(b)
                    open_.append(b)
        rest = {x for e in edges for x in e} - seen
        if rest:
            out[cut] = rest
    return out


def test_bridges_and_masks_of_random_molecules(spark):
    rng = random.Random(6)
    mols, rows = {}, []
    for m in range(12):
        n = rng.randrange(2, 26)
        names = rng.sample(range(100), n)
        edges = {tuple(sorted((names[i], names[rng.randrange(max(0, i - 4), i)]))) for i in range(1, n)}
        edges |= {tuple(sorted(rng.sample(names, 2))) for _ in range(rng.randrange(0, 4))} if n > 2 else set()
        mols[m] = sorted(edges)
        rows += [(m, *(e if rng.random() < 0.5 else e[::-1]), 1, i) for i, e in enumerate(mols[m])]
    rows += [(50, 1, 2, 1, 0), (50, 2, 3, 1, 1), (50, 7, 8, 1, 2), (50, 8, 9, 1, 3), (50, 9, 7, 1, 4)]  # not connected: the part of the smallest atom
    bonds = spark.createDataFrame(rows, "mol_id int, a int, b int, bond_type int, bond_idx int")
    sides = {(r.mol_id, tuple(sorted((r.atom, r.parent)))): (r.below, r.total) for r in gr.bond_sides(bonds).collect()}
    masks = {}
    for r in gr.rotation_masks(bonds).collect():
        masks.setdefault((r.mol_id, tuple(sorted((r.src, r.dst)))), set()).add(r.atom)
    for m, edges in mols.items():
        want = split_by_hand(edges)
        total = len({x for e in edges for x in e})
        assert {k[1]: v for k, v in sides.items() if k[0] == m} == {e: (len(s), total) for e, s in want.items()}
        for e, below in want.items():
            small = below if len(below) < total - len(below) else {x for f in edges for x in f} - below
            assert masks.get((m, e)) == (small if len(small) > 1 else None)
    assert {k[1] for k in sides if k[0] == 50} == {(1, 2), (2, 3)}


def test_rounds_of_long_chains(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(gr, "cut_lineage", lambda df, cut=gr.cut_lineage: calls.append(1) or cut(df))
    rounds = {}
    for n in (40, 2000):
        calls.clear()
        chain = spark.createDataFrame([(n, (i * 7) % n, ((i + 1) * 7) % n, 1) for i in range(n - 1)], "mol_id int, a int, b int, bond_type int")
        tree = gr.spanning_tree(chain).collect()
        rounds[n] = len(calls)
        assert len(tree) == n and sorted(r.place for r in tree) == list(range(n)) and {r.total for r in tree} == {n}
    assert rounds[2000] < 3 * rounds[40] < 200


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_vectors_are_exact(spark, p):
    rows = [(i, [float((i * a) % 17) for a in (3, 5, 7, 11)]) for i in range(120)] + [(200 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    near = ln.knn_vectors(df.select(F.col("id").alias("q_id"), "vec"), df.select(F.col("id").alias("p_id"), "vec"), 5, p=p, pivots=6, block=8)
    got = {}
    for r in near.collect():
        got.setdefault(r.q_id, []).append((round(r.distance, 6), r.p_id))
    for i, a in rows:
        want = sorted((round(sum(abs(x - y) ** p for x, y in zip(a, b)) ** (1 / p), 6), j) for j, b in rows)[:5]
        assert sorted(got[i]) == want


def test_user_function_retries_timeouts_and_failures(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "i long")

    def fn(row):
        if row["i"] == 2:
            raise ValueError("no")
        if row["i"] == 4:
            time.sleep(5)
        return {"y": row["i"] * 2.0}

    out = {r.i: r for r in rt.robust_map(df, fn, "y double", timeout_s=0.5, fallback={"y": -1.0}).collect()}
    assert (out[0].status, out[0].y) == ("ok", 0.0)
    assert out[2].status == "failed" and out[2].y is None and "ValueError" in out[2].error
    assert (out[4].status, out[4].y) == ("timeout", -1.0)


def test_scores_are_sampled_in_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "i long")

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        assert len(pdf) <= 2
        return pd.DataFrame({"i": pdf["i"], "n": pdf["sample_no"]})

    assert rt.score_complexes(df, model, "i long, n int", samples=3, batch_size=2).distinct().count() == 15


def test_table_functions_in_sql(spark):
    rt.register_table_functions(spark)
    rows = spark.sql("SELECT * FROM fasta_rows('>a\nMK\nT\n>b\nA')").collect()
    assert [(r.rec_idx, r.label, r.sequence) for r in rows] == [(0, "a", "MKT"), (1, "b", "A")]
    assert spark.sql("SELECT sum(ref_idx) s, count(*) n FROM alignment_rows('A-C', 'AG-')").first() == (1, 3)


def test_incremental_run_resumes_without_duplicates(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int").write.parquet(src)

    def run():
        stream = spark.readStream.schema("name string, v int").parquet(src)
        inc.process_incremental(stream, lambda d: d.withColumn("w", F.col("v") * 10), out, state).awaitTermination()
        return sorted((r.name, r.w) for r in spark.read.parquet(out).collect())

    assert run() == [("a", 10), ("b", 20)]
    spark.createDataFrame([("b", 2), ("c", 3)], "name string, v int").write.mode("append").parquet(src)
    assert run() == [("a", 10), ("b", 20), ("c", 30)]


def test_screening_batches_merge_as_they_land(spark, tmp_path):
    for batch, rows in {"b1": "idx_0,1.5\nidx_1,2.5\nidx_0,9.9", "b2": "idx_1,3.5"}.items():
        (tmp_path / batch).mkdir()
        (tmp_path / batch / "affinity_prediction.csv").write_text("name,affinity\n" + rows + "\n")
    assert ts.read_screening_batches(spark, str(tmp_path)).count() == 4
    inputs = spark.createDataFrame([("b1", 0, "x"), ("b1", 1, "y"), ("b2", 1, "z")], "batch string, row_idx long, ligand string")
    merged = inc.stream_merge(inc.stream_predictions(spark, str(tmp_path)), inputs)
    q = merged.writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.ligand for r in spark.table("merged").collect()) == ["x", "y", "z"]


def test_ids_come_from_whole_paths(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "one.pdb").write_text(PDB)
    atoms = pdb.read_pdb(spark, f"{tmp_path}/*/one.pdb")
    assert atoms.select("structure_id").distinct().count() == 2 and atoms.count() == 12
    by_folder = pdb.read_pdb(spark, f"{tmp_path}/*/one.pdb", id_pattern=r"([^/]+)/one\.pdb$")
    assert {r.structure_id for r in by_folder.collect()} == {"a", "b"}


def test_rules_that_dropped_rows_are_errors(spark, tmp_path):
    from structscreen.operators import rigid as rg
    from structscreen.operators import tables as tb

    cache = spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "name string, values array<double>")
    with pytest.raises(Exception, match="not once in every cache"):
        tb.combine_caches([cache, cache.limit(1)]).collect()
    metal = spark.createDataFrame([("Po", 1.0, 2.0, 3.0)], "symbol string, x double, y double, z double")
    assert rg.center_of_mass(metal).first()["y"] == 2.0
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 3)], "name string, v int").write.parquet(src)
    stream = spark.readStream.schema("name string, v int").parquet(src)
    with pytest.raises(Exception, match="different rows for b"):
        inc.process_incremental(stream, lambda d: d, out, state).awaitTermination()


def test_prediction_files_keep_all_columns(spark, tmp_path):
    preds = spark.createDataFrame([("1", "x", 0.5, 1.5), ("6", "y", 0.6, 2.5)], "batch string, name string, lddt double, affinity double")
    ts.write_screening_batches(preds, str(tmp_path / "r"))
    got = ts.read_screening_batches(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, got.select("batch", "name", "lddt", "affinity").collect())) == [("1", "x", 0.5, 1.5), ("6", "y", 0.6, 2.5)]
    with pytest.raises(Exception, match="header"):
        ts.read_screening_batches(spark, str(tmp_path / "r"), "name string, affinity double, rank int").collect()


def test_several_blocks_of_one_mol_file(spark, tmp_path):
    from structscreen.sources import ligand as lg

    block = "mol\n  x\n\n  2  1  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 C   0  0\n    1.0000    0.0000    0.0000 O   0  0\n  1  2  1  0\nM  END\n$$$$\n"
    (tmp_path / "two.sdf").write_text(block + block.replace(" O ", " N "))
    atoms, bonds = lg.read_sdf(spark, str(tmp_path / "two.sdf"), id_pattern=li.STEM)
    assert sorted((r.mol_id, r.record_idx, r.symbol) for r in atoms.collect()) == [("two", 0, "C"), ("two", 0, "O"), ("two", 1, "C"), ("two", 1, "N")]
    assert bonds.count() == 2
