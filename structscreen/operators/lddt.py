"""lDDT: reference distances that models conserve, with the labels of symmetric atoms resolved.

Reference pairs are searched once per target and block of models: an atom carries the places that up
to ``BLOCK`` models give it, so the grid join sees every reference atom once, however many models
there are, and neither pairs nor places meet again afterwards.

The two labellings of a residue's symmetric atoms are scored in the same pass.  A pair of which one end
is ambiguous is summed per residue under both labellings; a pair of two such ends is summed per pair of residues
under all four.  The sums of a residue against unambiguous atoms say which labelling it takes, and the sums of
that labelling are then its score: no second search, no second look at any pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structscreen import constants as k
from structscreen.functions import vec as v
from structscreen.operators.rigid import match_atoms
from structscreen.operators.spatial import XYZ, near_any, radius_pairs
from structscreen.operators.structure import conserved, symmetry_class
from structscreen.plans.skew import attach

BLOCK = 64
_LABELS = ("mm", "sm", "ms", "ss")  # places of the two ends: the model's own (m) or the partner's (s)


def first_chain(atoms: DataFrame, by, *, chain="chain", order="line_idx") -> DataFrame:
    """Atoms of the chain that comes first in each structure."""
    by = list(by)
    first = atoms.groupBy(*by).agg(F.min_by(F.col(chain), F.col(order)).alias("__first"))
    return attach(atoms, first, by, "inner").where(F.col(chain).eqNullSafe(F.col("__first"))).drop("__first")


def lddt_input(
    ref: DataFrame, model: DataFrame, target=("target",), pose=("pose",), *, residue="residue_idx", resname="resname",
    atom="atom_name", chain="chain", order="line_idx", matches: DataFrame | None = None,
) -> DataFrame:
    """Atoms of the reference that a model has too, one row per model: (target, pose, res_idx, atom, amb, rx ry rz, mx my mz).

    Both tables hold the first chain of a structure or more, of which the first is taken.  Residues
    pair by ``residue``, or by ``matches`` (target, pose, ref_residue, model_residue), atoms by name.
    """
    target, pose = list(target), list(pose)
    ref, model = first_chain(ref, target, chain=chain, order=order), first_chain(model, [*target, *pose], chain=chain, order=order)
    if matches is not None:
        told = matches.select(*target, *pose, F.col("model_residue").alias(residue), F.col("ref_residue").alias("__r"))
        model = attach(model, told, [*target, *pose, residue], "inner").drop(residue).withColumnRenamed("__r", residue)
    names = [residue, atom]
    places = model.select(*target, *pose, *names, *[F.col(c).alias(f"m{c}") for c in XYZ])
    known = ref.select(*target, *names, symmetry_class(F.col(resname), F.col(atom)).alias("amb"), *[F.col(c).alias(f"r{c}") for c in XYZ])
    return attach(places, known, [*target, *names], "inner").select(
        *target, *pose, F.col(residue).alias("res_idx"), F.col(atom).alias("atom"), "amb", *[f"r{c}" for c in XYZ], *[f"m{c}" for c in XYZ]
    )


def unmatched_atoms(ref: DataFrame, model: DataFrame, by, *, residue="residue_idx", atom="atom_name") -> DataFrame:
    """Per group: heavy reference atoms without a partner in the model, with a warning flag above ten."""
    return match_atoms(ref, model, by, index=residue, atom=atom)[1]


def _with_partner(atoms: DataFrame, by, residue, index, flags=()) -> DataFrame:
    """Add the places (s*) and flags of the symmetric partner, and whether the residue can swap.

    Within a residue the n-th atom of class 1 partners the n-th of class 2; both classes
    must have the same number of atoms present.  Everything is a window over one residue,
    so the table is shuffled once, by residue.
    """
    res = Window.partitionBy(*by, residue)
    counts = [F.count_if(F.col("amb") == c).over(res) for c in (1, 2)]
    out = atoms.withColumns({"__n1": counts[0], "__n2": counts[1]})
    out = out.withColumn("__at", F.row_number().over(Window.partitionBy(*by, residue, "amb").orderBy(index)))
    # in the order (n-th, class) partners stand side by side
    pairs = Window.partitionBy(*by, residue, F.col("amb") > 0).orderBy("__at", "amb")
    place = F.struct("mx", "my", "mz", *flags)
    partner = F.when(F.col("amb") == 1, F.lead(place).over(pairs)).when(F.col("amb") == 2, F.lag(place).over(pairs))
    swaps = (F.col("__n1") == F.col("__n2")) & (F.col("amb") > 0)
    out = out.withColumn("__s", F.when(swaps, partner)).withColumn("swaps", swaps)
    return out.select(
        *atoms.columns, "swaps", *[F.coalesce(F.col("__s")[f"m{c}"], F.col(f"m{c}")).alias(f"s{c}") for c in XYZ],
        *[F.coalesce(F.col("__s")[f], F.col(f)).alias(f"s_{f}") for f in flags],
    )


def _places(atoms: DataFrame, by, residue, index, ligand, cutoff, resolve) -> DataFrame:
    """Atoms with both places, the site flags of both, and ``swaps``."""
    if not resolve:
        atoms = atoms.withColumn("amb", F.lit(0))
    site = F.lit(False)
    if ligand is not None:
        model = atoms.select(*by, index, *[F.col(f"m{c}").alias(c) for c in XYZ])
        near = near_any(model, ligand, cutoff, by, id_col=index)
        atoms = attach(atoms, near.withColumn("__site", F.lit(True)), [*by, index])
        site = F.coalesce("__site", F.lit(False))
    atoms = atoms.withColumn("site", site).select(*by, index, residue, "amb", *[f"r{c}" for c in XYZ], *[f"m{c}" for c in XYZ], "site")
    return _with_partner(atoms, by, residue, index, ("site",))


_ONE = ["mx", "my", "mz", "sx", "sy", "sz", "site", "s_site", "swaps"]


def _pair_sums(points: DataFrame, by, radius, seq_sep, keys) -> DataFrame:
    """Sums over the reference pairs of ``points`` (by, idx, res, amb, x y z, models).

    ``keys`` names what stands beside (by, slot): columns of the two ends (a_*, b_*) and a_free, b_free, which say that the
    end is bound to one labelling.  Sums: n, and for each labelling of the ends the conserved (c_*), conserved at the site (k_*) and
    site (n_*) distances; p and s are those of an ambiguous end against unambiguous atoms under its two labellings.
    """
    pairs = radius_pairs(points, radius, by, id_col="idx", cols=["res", "amb", "models"])
    pairs = pairs.where(F.abs(F.col("a_res") - F.col("b_res")) > seq_sep)
    both = pairs.select(*by, "a_res", "b_res", "a_amb", "b_amb", "distance", F.posexplode(F.arrays_zip("a_models", "b_models")).alias("slot", "m"))
    both = both.where("m.a_models IS NOT NULL AND m.b_models IS NOT NULL")
    flat = both.select(
        *by, "slot", "a_res", "b_res", "a_amb", "b_amb", "distance",
        *[F.col(f"m.{e}_models.{c}").alias(f"{e}_{c}") for e in "ab" for c in _ONE],
    ).withColumns({f"{e}_free": ~F.col(f"{e}_swaps") for e in "ab"})

    def kept(one: str, two: str) -> Column:
        change = F.abs(v.dist(v.vec(f"a_{one}"), v.vec(f"b_{two}")) - F.col("distance"))
        return conserved(change)

    flat = flat.withColumn("c_mm", kept("m", "m")).withColumns({
        "c_sm": F.when(F.col("a_free"), F.col("c_mm")).otherwise(kept("s", "m")),
        "c_ms": F.when(F.col("b_free"), F.col("c_mm")).otherwise(kept("m", "s")),
    })
    flat = flat.withColumn("c_ss", F.when(F.col("a_free"), F.col("c_ms")).when(F.col("b_free"), F.col("c_sm")).otherwise(kept("s", "s")))
    at = {one + two: F.col("a_site" if one == "m" else "a_s_site") & F.col("b_site" if two == "m" else "b_s_site") for one in "ms" for two in "ms"}
    tells = (~F.col("a_free") & (F.col("b_amb") == 0)) | (~F.col("b_free") & (F.col("a_amb") == 0))
    swapped = F.when(F.col("b_free"), F.col("c_sm")).otherwise(F.col("c_ms"))
    return flat.groupBy(*by, "slot", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"c_{x}").alias(f"c_{x}") for x in _LABELS],
        *[F.coalesce(F.sum(F.when(at[x], F.col(f"c_{x}"))), F.lit(0)).alias(f"k_{x}") for x in _LABELS],
        *[F.count_if(at[x]).alias(f"n_{x}") for x in _LABELS],
        F.coalesce(F.sum(F.when(tells, F.col("c_mm"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(tells, swapped)), F.lit(0)).alias("s"),
    )


def _points(placed: DataFrame, by, residue, index) -> DataFrame:
    """One model per group: its places as a list of one."""
    return placed.select(
        *by, F.col(index).alias("idx"), F.col(residue).alias("res"), "amb", *[F.col(f"r{c}").alias(c) for c in XYZ],
        F.array(F.struct(*_ONE)).alias("models"),
    )


def _blocks(placed: DataFrame, target, pose, residue, index) -> tuple[DataFrame, DataFrame]:
    """Points of targets with the places of up to ``BLOCK`` models each, and (target, pose, __block, slot)."""
    number = F.row_number().over(Window.partitionBy(*target).orderBy(*pose)) - 1
    models = placed.select(*target, *pose).distinct().withColumn("__k", number)
    models = models.select(*target, *pose, F.floor(F.col("__k") / BLOCK).cast("int").alias("__block"), (F.col("__k") % BLOCK).cast("int").alias("slot"))
    told = attach(placed, models, [*target, *pose], "inner")
    by_slot = F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*_ONE))))
    listed = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("__m"))), lambda i: F.col("__m")[i])
    place = [F.max(f"r{c}").alias(c) for c in XYZ]
    points = told.groupBy(*target, "__block", F.col(index).alias("idx"), F.col(residue).alias("res"), "amb").agg(*place, by_slot.alias("__m"))
    return points.select(*target, "__block", "idx", "res", "amb", *XYZ, listed.alias("models")), models


def _totals(sums: DataFrame, by) -> DataFrame:
    """Per (by, slot): the counts under the labellings that its residues take."""
    plain, two = F.col("r1").isNull(), F.col("r2").isNotNull()
    own = F.struct(*[F.col(f"{x}_mm").alias(x) for x in "ckn"])
    # a bound end counts alike under both labels, so one of sm and ms is mm
    other = F.struct(*[(F.col(f"{x}_sm") + F.col(f"{x}_ms") - F.col(f"{x}_mm")).alias(x) for x in "ckn"])
    single = F.when(~plain & ~two, F.struct(F.col("r1").alias("r"), (F.col("s") > F.col("p")).alias("swap"), own.alias("m"), other.alias("s")))
    double = F.when(two, F.struct("r1", "r2", *[F.struct(*[F.col(f"{x}_{w}").alias(x) for x in "ckn"]).alias(w) for w in _LABELS]))
    zero = lambda c: F.coalesce(F.sum(F.when(plain, F.col(c))), F.lit(0)).alias(c)
    grouped = sums.groupBy(*by, "slot").agg(
        F.sum("n").alias("n"), *[zero(f"{x}_mm") for x in "ckn"], F.collect_list(single).alias("one"), F.collect_list(double).alias("two")
    )
    grouped = grouped.withColumn("swapped", F.transform(F.filter("one", lambda x: x["swap"]), lambda x: x["r"]))

    def total(x: str) -> Column:
        alone = F.aggregate("one", F.lit(0).cast("long"), lambda a, e: a + F.when(e["swap"], e["s"][x]).otherwise(e["m"][x]))
        turned = lambda r: F.array_contains("swapped", r)
        both = F.aggregate("two", F.lit(0).cast("long"), lambda a, e: a + F.when(
            turned(e["r1"]), F.when(turned(e["r2"]), e["ss"][x]).otherwise(e["sm"][x])
        ).otherwise(F.when(turned(e["r2"]), e["ms"][x]).otherwise(e["mm"][x])))
        return F.col(f"{x}_mm") + alone + both

    return grouped.select(
        *by, "slot", total("c").alias("conserved_distances"), (F.col("n") * 4).alias("total_n_distances"),
        total("k").alias("bs_conserved"), (total("n") * 4).alias("bs_total"),
    )


def _scores(totals: DataFrame) -> DataFrame:
    return totals.withColumns({
        "lddt": F.coalesce(F.try_divide("conserved_distances", "total_n_distances"), F.lit(0.0)),
        "bs_lddt": F.col("bs_conserved") / (F.lit(k.SITE_EPS) + F.col("bs_total")),
    })


def _ends() -> list[Column]:
    """Residues of the ends that two labellings are open to: of one such end r1, of two r1 and r2."""
    one = F.when(~F.col("a_free"), F.col("a_res")).when(~F.col("b_free"), F.col("b_res"))
    return [one.alias("r1"), F.when(~F.col("a_free") & ~F.col("b_free"), F.col("b_res")).alias("r2")]


def _turned(totals: DataFrame, groups: DataFrame, by) -> DataFrame:
    counts = ["conserved_distances", "total_n_distances", "bs_conserved", "bs_total"]
    return _scores(attach(groups, totals, by).na.fill(0, counts) if by else totals)  # groups without a pair score 0


def lddt(
    atoms: DataFrame, by=("pose_id",), *, residue="res_idx", index="atom_idx", radius=15.0, seq_sep=0, resolve=True,
    ligand: DataFrame | None = None, cutoff=4.0,
) -> DataFrame:
    """lddt, conserved and total distances per group, and the binding-site values.

    ``atoms``: by, index, residue, amb (0/1/2), rx ry rz (reference), mx my mz (model).  The binding-site
    score is 0 when no atom is near the ligand.
    """
    by = list(by)
    placed = _places(atoms, by, residue, index, ligand, cutoff, resolve)
    sums = _pair_sums(_points(placed, by, residue, index), by, radius, seq_sep, _ends())
    return _turned(_totals(sums, by).drop("slot"), atoms.select(*by).distinct(), by)


def lddt_of_models(
    atoms: DataFrame, target=("target",), pose=("pose",), *, residue="res_idx", index="atom", radius=15.0, seq_sep=0, resolve=True,
    ligand: DataFrame | None = None, cutoff=4.0,
) -> DataFrame:
    """The same per (target, pose) for many models of a target; ``atoms`` as ``lddt_input`` gives them.

    The pairs of a target are searched once for up to ``BLOCK`` models.  Atoms are known by (residue, index).
    """
    target, pose = list(target), list(pose)
    by = [*target, *pose]
    atoms = atoms.withColumn("__id", F.struct(residue, index))
    placed = _places(atoms, by, residue, "__id", ligand, cutoff, resolve)
    points, models = _blocks(placed, target, pose, residue, "__id")
    totals = _totals(_pair_sums(points, [*target, "__block"], radius, seq_sep, _ends()), [*target, "__block"])
    named = attach(models, totals, [*target, "__block", "slot"]).drop("__block", "slot")
    return _scores(named.na.fill(0, ["conserved_distances", "total_n_distances", "bs_conserved", "bs_total"]))


def symmetry_choices(sums: DataFrame, by) -> DataFrame:
    """(by, slot, res) of the residues that take the swapped labels, from sums kept per end (a_res, b_res, a_free, b_free).

    They do so if that conserves strictly more of their distances to unambiguous atoms.
    """
    res = F.when(~F.col("a_free"), F.col("a_res")).otherwise(F.col("b_res")).alias("res")
    told = sums.where("a_free <> b_free").groupBy(*by, "slot", res).agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
    return told.where("s > p").select(*by, "slot", "res")


_KEPT_ENDS = ("a_res", "b_res", "a_free", "b_free")


def resolve_symmetry(atoms: DataFrame, by, *, residue="res_idx", index="atom_idx", radius=15.0, seq_sep=0) -> DataFrame:
    """``atoms`` with the model places (mx my mz) of the labels that each residue takes."""
    by = list(by)
    placed = _places(atoms, by, residue, index, None, 0.0, True)
    sums = _pair_sums(_points(placed, by, residue, index), by, radius, seq_sep, _KEPT_ENDS)
    swapped = symmetry_choices(sums, by).select(*by, F.col("res").alias(residue), F.lit(True).alias("__swap"))
    chosen = attach(placed.select(*by, index, residue, *[f"s{c}" for c in XYZ], "swaps"), swapped, [*by, residue])
    moved = chosen.select(*by, index, (F.col("swaps") & F.coalesce("__swap", F.lit(False))).alias("__take"), *[f"s{c}" for c in XYZ])
    out = attach(atoms, moved, [*by, index])
    return out.withColumns({f"m{c}": F.when(F.col("__take"), F.col(f"s{c}")).otherwise(F.col(f"m{c}")) for c in XYZ}).select(*atoms.columns)


def lddt_per_residue(atoms: DataFrame, by=("pose_id",), *, residue="res_idx", index="atom_idx", radius=15.0, seq_sep=0, resolve=True) -> DataFrame:
    """Score, conserved and total per residue; each pair counts for both its residues."""
    by = list(by)
    placed = _places(atoms, by, residue, index, None, 0.0, resolve)
    sums = _pair_sums(_points(placed, by, residue, index), by, radius, seq_sep, _KEPT_ENDS)
    if resolve:
        swapped = symmetry_choices(sums, by).withColumn("__swap", F.lit(True))
        for end in "ab":
            sums = attach(sums, swapped.select(*by, "slot", F.col("res").alias(f"{end}_res"), F.col("__swap").alias(f"__{end}")), [*by, "slot", f"{end}_res"])
        turn = {e: ~F.col(f"{e}_free") & F.coalesce(f"__{e}", F.lit(False)) for e in "ab"}
        kept = F.when(turn["a"], F.when(turn["b"], F.col("c_ss")).otherwise(F.col("c_sm"))).otherwise(F.when(turn["b"], F.col("c_ms")).otherwise(F.col("c_mm")))
    else:
        kept = F.col("c_mm")
    ends = sums.select(*by, F.explode(F.array("a_res", "b_res")).alias("res_idx"), kept.alias("kept"), "n")
    out = ends.groupBy(*by, "res_idx").agg(F.sum("kept").alias("conserved"), (F.sum("n") * 4).alias("total"))
    return out.withColumn("score", F.col("conserved") / F.col("total"))
