import random

import pytest
from pyspark.sql import functions as F

from structscreen.functions import text as tx
from structscreen.operators import align as al
from structscreen.operators import sampling as sm
from structscreen.operators import sequence as sq
from structscreen.operators import spatial as sp
from structscreen.operators.tables import job_fingerprint


def ids(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(tx.token_ids(F.col("t"), **kw).alias("i")).first().i


@pytest.mark.parametrize("text, want", [
    ("MKTVRQG", [0, 20, 15, 11, 7, 10, 16, 6, 2]),
    ("KALTA<mask>ISQP", [0, 15, 5, 4, 11, 5, 32, 12, 8, 16, 14, 2]),
    ("K A <mask> I S Q", [0, 15, 5, 32, 12, 8, 16, 2]),
    ("", [0, 2]),
])
def test_token_goldens(spark, text, want):
    assert ids(spark, text) == want


def test_token_truncation_comes_before_the_end_symbol(spark):
    assert ids(spark, "MKTVRQGMKTVRQG", truncate=10) == [0, 20, 15, 11, 7, 10, 16, 6, 20, 15, 11, 2]


def test_token_rows_without_end_and_padding(spark):
    assert ids(spark, "KAAISQQ", eos=False) == [0, 15, 5, 5, 12, 8, 16, 16]
    df = spark.createDataFrame([("MK",)], "t string")
    assert df.select(tx.pad_ids(tx.token_ids(F.col("t")), F.lit(6)).alias("i")).first().i == [0, 20, 15, 2, 1, 1]


def test_unknown_symbol_policies(spark):
    with pytest.raises(Exception, match="vocabulary"):
        ids(spark, "MJK")
    assert ids(spark, "MJK", on_unknown="unk") == [0, 20, 3, 15, 2]


def greedy(sizes, budget, additive):
    batches, buf, used, longest = [], [], 0, 0
    for n, i in sorted(sizes):
        full = n + used > budget and used > 0 if additive else max(n, longest) * (len(buf) + 1) > budget
        if full:
            if buf:
                batches.append(buf)
            buf, used, longest = [], 0, 0
        buf.append(i)
        used, longest = used + n, max(longest, n)
    return [*batches, buf]


@pytest.mark.parametrize("additive", [False, True])
@pytest.mark.parametrize("budget", [1, 7, 40, 100, 1000])
def test_batches_equal_the_row_by_row_rule(spark, additive, budget):
    sizes = [((i * 7919) % 23 + (40 if i % 31 == 0 else 1), i) for i in range(150)]
    df = spark.createDataFrame([(i, n) for n, i in sizes], "idx long, length int")
    out = (sq.pack_additive if additive else sq.pack_padded)(df, budget)
    got = {}
    for r in out.collect():
        got.setdefault(r.batch_no, []).append(r.idx)
    want = greedy(sizes, budget, additive)
    assert [sorted(got[b]) for b in sorted(got)] == [sorted(b) for b in want]


def test_greedy_selection_against_brute_force(spark):
    seqs = ["AAAA", "AAAB", "BBBB", "ABAB", "CCCC", "AABB"]
    df = spark.createDataFrame(list(enumerate(seqs)), "rec_idx long, sequence string")

    def dist(a, b):
        return sum(x != y for x, y in zip(a, b)) / len(a)

    for mode in ("max", "min"):
        chosen = [0]
        while len(chosen) < 4:
            rest = [i for i in range(len(seqs)) if i not in chosen]
            key = {i: sum(dist(seqs[i], seqs[c]) for c in chosen) / len(chosen) for i in rest}
            chosen.append(max(rest, key=lambda i: key[i]) if mode == "max" else min(rest, key=lambda i: key[i]))
        got = [r.rec_idx for r in sq.greedy_select(df, 4, mode).collect()]
        assert got == sorted(chosen)


def test_alignment_columns_and_errors(spark):
    df = spark.createDataFrame([(1, "AC-DÉ", "A-GD-"), (2, "", ""), (3, "--", "AB")], "id int, ref_aln string, mod_aln string")
    rows = [(r.id, r.col, r.ref_char, r.mod_char, r.ref_idx, r.mod_idx) for r in al.explode_alignment(df).orderBy("id", "col").collect()]
    assert rows == [
        (1, 0, "A", "A", 0, 0), (1, 1, "C", "-", 1, None), (1, 2, "-", "G", None, 1), (1, 3, "D", "D", 2, 2), (1, 4, "É", "-", 3, None),
        (3, 0, "-", "A", None, 0), (3, 1, "-", "B", None, 1),
    ]
    bad = spark.createDataFrame([(1, "AC", "A")], "id int, ref_aln string, mod_aln string")
    with pytest.raises(Exception, match="differ in length"):
        al.explode_alignment(bad).count()


@pytest.mark.parametrize("idx", [[0, 1, 2, 3, 9, 10, 11, 12, 13, 20], [0, 1, 2, 3, 4, 9, 10, 11, 20, 21], [5], [1, 3, 5, 7]])
def test_short_runs_rule(spark, idx):
    dropped, start, pre, count = [], idx[0], idx[0], 0
    for i in idx[1:]:
        if pre + 1 != i:
            if count <= 3:
                dropped += list(range(start, pre + 1))
            count, start = 0, i
        count += 1
        pre = i
    df = spark.createDataFrame([(1, i) for i in idx], "id int, idx long")
    assert sorted(r.idx for r in al.drop_short_runs(df).collect()) == [i for i in idx if i not in dropped]


def test_fill_gaps_interpolates_between_the_ends(spark):
    rows = [(1, i, float(i), 0.0, 0.0, None if i in (0, 3, 4) else float(i) + (1.0 if i < 3 else 4.0), 0.0, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "structure_id int, ref_idx long, x double, y double, z double, mx double, my double, mz double")
    got = {r.ref_idx: r.mx for r in al.fill_gaps(df).collect()}
    assert got[0] is None  # nothing before it
    assert got[3] == pytest.approx(3 + 1 * (2 / 3) + 4 * (1 / 3)) and got[4] == pytest.approx(4 + 1 * (1 / 3) + 4 * (2 / 3))


def test_fingerprint_equals_checksum_of_the_joined_text(spark, heavy):
    import zlib

    jobs = [(i, f"C{i}=O" * (i % 5), f"/data/p{i % 7}.pdb") for i in range(60)]
    df = spark.createDataFrame(jobs, "row_idx long, ligand string, protein_path string")
    want = zlib.crc32(("".join(j[1] for j in jobs) + "".join(j[2] for j in jobs)).encode())
    assert job_fingerprint(df).first().fingerprint == want


def test_longest_fragment_first_of_equals(spark):
    df = spark.createDataFrame([("CC.CCO.NCO",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(tx.longest_fragment(F.col("s"))).collect()] == ["CCO", "", ""]


@pytest.mark.parametrize("mode", ["max", "min"])
def test_greedy_subset_equals_brute_force(spark, mode):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("ACD-") for _ in range(7))) for i in rng.sample(range(500), 40)]
    rows += [(900, rows[0][1]), (901, rows[0][1])]
    df = spark.createDataFrame(rows, "rec_idx long, sequence string")
    seqs, chosen = dict(rows), [min(rows)[0]]
    while len(chosen) < 9:
        far = lambda i: sum(sum(a != b for a, b in zip(seqs[i], seqs[j])) for j in chosen)
        chosen.append(min((i for i in seqs if i not in chosen), key=lambda i: (-far(i) if mode == "max" else far(i), i)))
    assert [r.rec_idx for r in sq.greedy_select(df, 9, mode).collect()] == sorted(chosen)
    assert sq.greedy_select(df.limit(3), 9, mode).count() == 3 and sq.greedy_select(df.limit(0), 3, mode).count() == 0


def test_sample_is_the_smallest_draws_however_they_fall(spark):
    df = spark.range(3000).withColumn("same", F.lit(7))
    smallest = [r.id for r in df.withColumn("d", tx.draw(5, F.col("id"))).orderBy("d", "id").limit(200).collect()]
    assert sorted(r.id for r in sm.sample_n(df, 200, keys=["id"], seed=5).collect()) == sorted(smallest)
    assert sm.sample_n(df, 200, keys=["same"], seed=5).count() == 200  # all draws alike
    assert sm.sample_n(df, 9000, keys=["id"]).count() == 3000 and sm.sample_n(df.limit(0), 5, keys=["id"]).count() == 0


def test_residues_stand_at_cb_or_ca(spark):
    rows = [("s", 1, "CA", 1, 1.0), ("s", 1, "CB", 2, 2.0), ("s", 2, "CA", 3, 3.0), ("s", 3, "N", 4, 4.0), ("s", 4, "CB", 5, 5.0), ("s", 4, "CB", 6, 6.0)]
    atoms = spark.createDataFrame(rows, "structure_id string, resid int, atom_name string, line_idx int, x double").selectExpr("*", "0D AS y", "0D AS z")
    got = {r.resid: (r.first_line, r.x) for r in sp.representative_points(atoms, ["structure_id", "resid"]).collect()}
    assert got == {1: (1, 2.0), 2: (3, 3.0), 4: (5, 5.0)}
