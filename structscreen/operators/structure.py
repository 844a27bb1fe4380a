"""Clash, ligand lDDT, geometry violations, contacts, anisotropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structscreen import constants as k
from structscreen.functions import vec as v
from structscreen.functions.text import literal_map
from structscreen.operators.spatial import XYZ, radius_join, radius_pairs
from structscreen.plans.skew import attach, over_groups


def vdw_radius(element: Column) -> Column:
    """Case-sensitive lookup; anything not listed has the default radius."""
    return F.coalesce(F.try_element_at(literal_map(k.VDW_RADII), element), F.lit(k.VDW_DEFAULT))


def clash_score(
    protein: DataFrame, ligand: DataFrame, by=("pose_id",), *, thr=4.0, element="element",
    symbol="symbol", mask: Column | None = None, protein_cols=(), ligand_cols=(),
) -> DataFrame:
    """Per group: clashScore, overlap_mean, clash_n, n.  Hydrogens of the protein do not count.

    ``mask`` is an extra condition on the pair columns (a_*, b_*).  Groups without any
    pair are kept when they have protein atoms: all zeros.
    """
    by = list(by)
    heavy = protein.where(F.coalesce(F.col(element), F.lit("")) != "H").withColumn("vdw", vdw_radius(F.col(element)))
    lig = ligand.withColumn("vdw", vdw_radius(F.col(symbol)))
    pairs = radius_join(heavy, lig, thr, by, a_cols=["vdw", *protein_cols], b_cols=["vdw", *ligand_cols])
    if mask is not None:
        pairs = pairs.where(mask)
    over = F.col("a_vdw") + F.col("b_vdw") - F.col("distance")
    pairs = pairs.select(*by, F.when(over > 0, over).alias("o"))
    scored = pairs.groupBy(*by).agg(
        F.sqrt(F.coalesce(F.sum(F.col("o") * F.col("o")), F.lit(0.0)) / (F.lit(k.CLASH_EPS) + F.count(F.lit(1)))).alias("clashScore"),
        F.coalesce(F.avg("o"), F.lit(0.0)).alias("overlap_mean"),
        F.count("o").alias("clash_n"), F.count(F.lit(1)).alias("n"),
    )
    if not by:
        return scored
    groups = protein.select(*by).distinct()
    return attach(groups, scored, by).na.fill(0.0, ["clashScore", "overlap_mean"]).na.fill(0, ["clash_n", "n"])


def conserved(deviation: Column, strict=False) -> Column:
    """How many of the four thresholds a distance change stays within."""
    def hit(t):
        return (deviation < t if strict else deviation <= t).cast("int")

    return sum((hit(t) for t in k.LDDT_THRESHOLDS[1:]), hit(k.LDDT_THRESHOLDS[0]))


def symmetry_class(resname: Column, atom_name: Column) -> Column:
    table = {f"{r}_{a}": c for r, atoms in k.SYMMETRIC_ATOMS.items() for a, c in atoms.items()}
    return F.coalesce(F.try_element_at(literal_map(table), F.concat_ws("_", resname, atom_name)), F.lit(0))


def cross_lddt(ref_ca: DataFrame, ref_lig: DataFrame, by=("pose_id",), *, radius=15.0, eps=k.WEIGHT_EPS) -> DataFrame:
    """lDDT of ligand-residue distances (strict thresholds).

    Both tables carry the reference place (x y z) and the model place (mx my mz).
    ``eps`` is added to the pair count; 0 gives the training form.
    """
    pairs = radius_join(ref_ca, ref_lig, radius, by, a_cols=["mx", "my", "mz"], b_cols=["mx", "my", "mz"])
    change = F.abs(v.dist(v.vec("a_m"), v.vec("b_m")) - F.col("distance"))
    score = F.sum(conserved(change, strict=True) * F.lit(0.25)) / (F.count(F.lit(1)) + F.lit(float(eps)))
    out = pairs.groupBy(*by).agg(score.alias("cross_lddt"), F.count(F.lit(1)).alias("n_pairs"))
    if not by:
        return out
    return attach(ref_lig.select(*by).distinct(), out, by).na.fill(0.0, ["cross_lddt"]).na.fill(0, ["n_pairs"])


# ------------------------------------------------------------------ geometry violations
def bond_violations(atoms: DataFrame, by=("pose_id",), *, index="atom_idx", directed=False, bonds: DataFrame | None = None, bond=2.0, limit=0.3) -> DataFrame:
    """Bonded pairs whose length changes by more than ``limit``.

    ``atoms`` carries reference x y z and model mx my mz.  Bonds are reference pairs
    closer than ``bond``, or the given table (by, a, b).  ``directed`` counts each twice.
    """
    by = list(by)
    if bonds is None:
        pairs = radius_pairs(atoms, bond, by, id_col=index, cols=["mx", "my", "mz"])
        length = F.col("distance")
    else:
        ends = atoms.select(*by, F.col(index).alias("__i"), *XYZ, "mx", "my", "mz")
        one = ends.select(*by, F.col("__i").alias("a"), *[F.col(c).alias(f"a_{c}") for c in (*XYZ, "mx", "my", "mz")])
        two = ends.select(*by, F.col("__i").alias("b"), *[F.col(c).alias(f"b_{c}") for c in (*XYZ, "mx", "my", "mz")])
        pairs = bonds.join(one, [*by, "a"], "inner").join(two, [*by, "b"], "inner")
        length = v.dist(v.vec("a_"), v.vec("b_"))
    change = F.abs(v.dist(v.vec("a_m"), v.vec("b_m")) - length)
    times = 2 if directed else 1
    return pairs.groupBy(*by).agg(
        (F.count_if(change > limit) * times).alias("violations"), (F.count(F.lit(1)) * times).alias("bonds")
    )


def ideal_bond_violations(atoms: DataFrame, bonds: DataFrame, by=("pose_id",), *, index="atom_idx", limit=0.3) -> DataFrame:
    """Bonds whose length differs from the ideal of their atom names by more than ``limit``.

    Bonds with an OXT end are skipped; names are looked up in either order.  Output per
    group: count, and the residue numbers involved (bounded by the residues in violation).
    """
    by = list(by)
    table = {f"{a}|{b}": d for (a, b), d in k.IDEAL_BONDS.items()}
    table.update({f"{b}|{a}": d for (a, b), d in k.IDEAL_BONDS.items()})
    cols = ("x", "y", "z", "atom_name", "resid")
    one = atoms.select(*by, F.col(index).alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    two = atoms.select(*by, F.col(index).alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = bonds.join(one, [*by, "a"], "inner").join(two, [*by, "b"], "inner")
    pairs = pairs.where("a_atom_name <> 'OXT' AND b_atom_name <> 'OXT'")
    ideal = F.try_element_at(literal_map(table), F.concat_ws("|", "a_atom_name", "b_atom_name"))
    ideal = F.coalesce(ideal, F.raise_error(F.lit("no ideal length for a bond")).cast("double"))
    bad = F.abs(ideal - v.dist(v.vec("a_"), v.vec("b_"))) > limit
    return pairs.withColumn("__bad", bad).groupBy(*by).agg(
        F.count_if("__bad").alias("violations"),
        F.array_sort(F.flatten(F.collect_set(F.when(F.col("__bad"), F.array("a_resid", "b_resid"))))).alias("residues"),
    ).withColumn("residues", F.array_distinct("residues"))


# --------------------------------------------------------------------------- contacts
def backbone_table(atoms: DataFrame, by=("structure_id", "chain"), residue=("resid", "insertion"), order="line_idx") -> DataFrame:
    """One row per residue with n_*, ca_*, c_* (null where missing); duplicates are an error."""
    by = list(by)
    keys = [*by, *residue]
    aggs = [F.min(order).alias("first_line")]
    for name, prefix in (("N", "n_"), ("CA", "ca_"), ("C", "c_")):
        here = F.col("atom_name") == name
        aggs += [F.max(F.when(here, F.col(c))).alias(prefix + c) for c in XYZ]
        aggs.append(F.count_if(here).alias(f"__{prefix}"))
    out = atoms.where(F.col("atom_name").isin("N", "CA", "C")).groupBy(*keys).agg(*aggs)
    twice = F.greatest("__n_", "__ca_", "__c_") > 1
    line = F.when(twice, F.raise_error(F.lit("duplicate backbone atom")).cast("long")).otherwise(F.col("first_line"))
    return out.withColumn("first_line", line).drop("__n_", "__ca_", "__c_")


def contacts(backbone: DataFrame, by=("structure_id",), *, index="pos", thr=8.0) -> tuple[DataFrame, DataFrame]:
    """(contacts i < j with distance of virtual C-beta below ``thr``, undefined positions).

    The map value is 1 for a listed pair, -1 for any pair with an undefined position, and
    0 otherwise; only the ones are stored, never a full L x L table.
    """
    placed = v.with_virtual_cb(backbone, "cb_", "n_", "ca_", "c_", k.CB_LENGTH, k.CB_ANGLE, k.CB_DIHEDRAL)
    parts = [p + c for p in ("n_", "ca_", "c_") for c in XYZ]
    missing = " OR ".join(f"{c} IS NULL OR isnan({c})" for c in parts)
    undefined = backbone.where(missing).select(*by, index)
    points = placed.where(f"NOT ({missing})").select(*by, index, *[F.col(f"cb_{c}").alias(c) for c in XYZ])
    pairs = radius_pairs(points, thr, by, id_col=index)
    return pairs.select(*by, F.col(f"a_{index}").alias("i"), F.col(f"b_{index}").alias("j"), "distance"), undefined


def contact_precision(pred: DataFrame, lengths: DataFrame, by=("structure_id",), ranges=k.CONTACT_RANGES) -> DataFrame:
    """Precision of the best-scored pairs per separation range.

    ``pred``: by, i, j (i < j), score, target (1, 0, or < 0 for undefined); ``lengths``:
    by, length.  Pairs are ordered by score (ties by i, j); the first L count, short lists
    are filled with misses.  P@L/b uses the first floor(b L / 10) pairs.
    """
    by = list(by)
    sep = F.col("j") - F.col("i")
    spans = F.array(*[
        F.struct(F.lit(n).alias("contact_range"), F.lit(lo).alias("lo"), F.lit(hi or 2**31 - 1).alias("hi")) for n, lo, hi in ranges
    ])
    rows = pred.where("target >= 0").withColumn("r", F.explode(spans)).where((sep >= F.col("r.lo")) & (sep < F.col("r.hi")))
    rows = rows.select(*by, "r.contact_range", (-F.col("score")).alias("neg"), "i", "j", F.col("target").cast("long").alias("target"))
    keys = [*by, "contact_range"]
    run = over_groups(rows, keys, ["neg", "i", "j"], at=("row_number",))
    run = attach(run, lengths, by, "inner").where(F.col("at") <= F.col("length"))
    tenths = range(1, 11)

    def first(b):
        return F.floor(F.lit(b) * F.col("length") / 10)

    hits = run.groupBy(*keys).agg(
        F.max("length").alias("length"),
        *[F.sum(F.when(F.col("at") <= first(b), F.col("target")).otherwise(0)).alias(f"h{b}") for b in tenths],
    )
    p = {b: F.col(f"h{b}") / F.greatest(first(b), F.lit(1)) for b in tenths}
    mean = sum((p[b] for b in range(2, 11)), p[1]) / 10
    scored = hits.select(*keys, mean.alias("auc"), p[10].alias("p_at_l"), p[5].alias("p_at_l2"), p[2].alias("p_at_l5"))
    names = F.explode(F.array(*[F.lit(r[0]) for r in ranges])).alias("contact_range")
    every = lengths.select(*by, names)  # ranges without a pair score 0
    return attach(every, scored, keys).na.fill(0.0, ["auc", "p_at_l", "p_at_l2", "p_at_l5"])


def symmetrize(long: DataFrame, by=(), value="value") -> DataFrame:
    """x + transpose(x) in long form."""
    both = F.explode(F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return long.select(*by, both.alias("e"), value).groupBy(*by, F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum(value).alias(value))


def apc(long: DataFrame, by=(), value="value") -> DataFrame:
    """Average-product correction: x_ij - row_i * column_j / total."""
    by = list(by)
    rows = long.groupBy(*by, "i").agg(F.sum(value).alias("__r"))
    cols = long.groupBy(*by, "j").agg(F.sum(value).alias("__c"))
    total = rows.groupBy(*by).agg(F.sum("__r").alias("__t"))
    out = attach(attach(long, rows, [*by, "i"]), cols, [*by, "j"])
    out = attach(out, total, by)
    return out.withColumn(value, F.col(value) - F.col("__r") * F.col("__c") / F.col("__t")).drop("__r", "__c", "__t")


def mu_r_norm(edges: DataFrame, by=(), *, node="a_idx", sigmas=k.ANISOTROPY_SIGMAS) -> DataFrame:
    """Neighbour anisotropy per node and scale: |sum w d| / sum w |d|, w = softmax(-d^2/s).

    The common factor of the softmax cancels, so plain exponentials relative to the
    nearest neighbour are enough and one shuffle on the node serves all scales.
    """
    by = [*by, node]
    nearest = edges.groupBy(*by).agg(F.min("distance").alias("__d0"))
    rows = attach(edges, nearest, by, "inner").withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in sigmas])))
    w = F.exp(-(F.col("distance") * F.col("distance") - F.col("__d0") * F.col("__d0")) / F.col("sigma"))
    d = v.sub(v.vec("a_"), v.vec("b_"))
    sums = rows.groupBy(*by, "sigma").agg(
        *[F.sum(w * c).alias(f"__{a}") for a, c in zip(XYZ, d)], F.sum(w * F.col("distance")).alias("__n")
    )
    return sums.select(*by, "sigma", (v.norm(v.vec("__")) / F.col("__n")).alias("mu_r_norm"))


def scatter(df: DataFrame, index, value: str, reduce="mean") -> DataFrame:
    index = [index] if isinstance(index, str) else list(index)
    return df.groupBy(*index).agg((F.avg if reduce == "mean" else F.sum)(value).alias(value))
