"""Chain geometry: orientations, backbone and side-chain dihedrals, chain concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structscreen import constants as k
from structscreen.functions import vec as v
from structscreen.functions.text import literal_map
from structscreen.plans.skew import attach, over_groups

XYZ = ("x", "y", "z")
RESIDUE = ("structure_id", "chain", "resid", "insertion")


def orientations(ca: DataFrame, by=("structure_id",), *, index="pos") -> DataFrame:
    """Unit vectors to the next and to the previous residue; zero at the ends."""
    place = ca.withColumn("__p", F.struct(*XYZ))
    out = over_groups(place, by, [index], __next=("lead", "__p"), __prev=("lag", "__p"))
    here = v.vec()
    for name, other in (("forward_", "__next"), ("backward_", "__prev")):
        out = v.with_vec(out, name, v.unit(v.sub(tuple(F.col(other)[c] for c in XYZ), here)))
    return out.drop("__p", "__next", "__prev")


def backbone_dihedrals(backbone: DataFrame, by=("structure_id",), *, index="pos") -> DataFrame:
    """phi, psi, omega with cosine and sine; an undefined angle is 0 (cosine 1, sine 0)."""
    place = backbone.withColumn("__b", F.struct(*[p + c for p in ("n_", "ca_", "c_") for c in XYZ]))
    out = over_groups(place, by, [index], __next=("lead", "__b"), __prev=("lag", "__b"))

    def at(side, atom):
        return tuple(F.col(side)[atom + c] for c in XYZ)

    n, ca, c = v.vec("n_"), v.vec("ca_"), v.vec("c_")
    angles = {
        "phi": v.dihedral(at("__prev", "c_"), n, ca, c),
        "psi": v.dihedral(n, ca, c, at("__next", "n_")),
        "omega": v.dihedral(ca, c, at("__next", "n_"), at("__next", "ca_")),
    }
    out = out.withColumns({a: F.coalesce(F.nanvl(e, F.lit(0.0)), F.lit(0.0)) for a, e in angles.items()})
    out = out.withColumns({f"{f}_{a}": getattr(F, f)(a) for a in angles for f in ("cos", "sin")})
    return out.drop("__b", "__next", "__prev")


def _chi_atoms() -> list[tuple]:
    """(residue, chi number, names of the four atoms, the same with the alternative last atom) from the chi paths."""
    rows = []
    for res, path in k.CHI_PATH.items():
        atoms = list(path)
        for chi in range(1, len(atoms) - 2):
            four = atoms[chi - 1:chi + 3]
            other = k.CHI_ALTERNATIVE.get(res)
            rows.append((res, chi, four, [*four[:3], other[1]] if other and other[0] == chi else None))
    return rows


def chi_angles(atoms: DataFrame, residue=RESIDUE) -> DataFrame:
    """(residue, resname, chi, angle, alt_angle, mask, alt_mask, symmetric).

    Angles are in [0, 2 pi).  For residues with two equivalent last atoms the larger angle
    is ``angle`` and the smaller one ``alt_angle``; both are needed or the chi is masked.
    Every chi of a residue has its row, masked where atoms are missing.  Each atom row goes to the
    angles of its residue, and one grouped pass puts the four points of an angle side by side.
    """
    keys = [*residue, "resname"]
    table = atoms.sparkSession.createDataFrame(_chi_atoms(), "__r string, chi int, __0 array<string>, __1 array<string>")
    rows = atoms.where("hetero = ' '").join(F.broadcast(table), F.col("resname") == F.col("__r"))  # a fixed table of some dozen rows
    # the place of the atom in the angle, null or 0 if it has none
    rows = rows.select(*keys, *XYZ, "chi", *[F.array_position(f"__{a}", F.col("atom_name")).alias(f"__at{a}") for a in (0, 1)])
    points = rows.groupBy(*keys, "chi").agg(*[
        F.max(F.when(F.col(f"__at{a}") == p + 1, F.col(c))).alias(f"__{a}{p}_{c}")
        for a in (0, 1) for p in range(4) for c in XYZ
    ])

    def angle(a):
        return F.pmod(v.dihedral(*[v.vec(f"__{a}{p}_") for p in range(4)]), F.lit(2 * 3.141592653589793))

    out = points.select(*keys, "chi", angle(0).alias("__m"), angle(1).alias("__a"))
    two = F.coalesce(F.try_element_at(literal_map({r: c for r, (c, _) in k.CHI_ALTERNATIVE.items()}), F.col("resname")), F.lit(0)) == F.col("chi")
    ok = F.when(two, F.col("__m").isNotNull() & F.col("__a").isNotNull()).otherwise(F.col("__m").isNotNull())
    zero = F.lit(0.0)
    return out.select(
        *keys, "chi",
        F.when(ok & two, F.greatest("__m", "__a")).when(ok, F.col("__m")).otherwise(zero).alias("angle"),
        F.when(ok & two, F.least("__m", "__a")).otherwise(zero).alias("alt_angle"),
        ok.cast("int").alias("mask"), (ok & two).cast("int").alias("alt_mask"),
        (F.col("resname").isin(*k.CHI_SYMMETRIC) & (F.col("chi") == 2)).cast("int").alias("symmetric"),
    )


def chi_bonds() -> list[tuple[str, int, str, str, list[str]]]:
    """(residue, chi, axis atom 1, axis atom 2, atoms that turn), from the side-chain lists."""
    out = []
    for res, path in k.CHI_PATH.items():
        atoms = list(path)
        side = k.SIDE_CHAIN[res]
        for chi in range(1, len(atoms) - 2):
            inner = set(atoms[:chi + 2])
            if chi > 1:
                inner |= set(k.INNER_BRANCH.get(res, ()))
            out.append((res, chi, atoms[chi], atoms[chi + 1], [a for a in side if a not in inner]))
    return out


def rotate_chi(atoms: DataFrame, turns: DataFrame, residue=RESIDUE) -> DataFrame:
    """Turn side chains: ``turns`` has the residue keys and ``angles`` (array of 5, null = leave).

    Bonds are turned from the inside out, each on the coordinates left by the one before.
    All steps are windows over the residue (at most a few dozen atoms), so the table is
    shuffled once.
    """
    residue = list(residue)
    out = attach(atoms, turns.select(*residue, "angles"), residue)
    w = Window.partitionBy(*residue)
    bonds = chi_bonds()
    for chi in range(1, k.MAX_CHI + 1):
        mine = [b for b in bonds if b[1] == chi]
        ends = [literal_map({b[0]: b[i] for b in mine}) for i in (2, 3)]
        moved = literal_map({b[0]: "," + ",".join(b[4]) + "," for b in mine})
        for e, end in enumerate(ends):
            here = F.col("atom_name") == F.try_element_at(end, F.col("resname"))
            out = out.withColumns({f"__e{e}_{c}": F.max(F.when(here, F.col(c))).over(w) for c in XYZ})
        a1, a2 = v.vec("__e0_"), v.vec("__e1_")
        axis = v.sub(a2, a1)
        out = v.with_vec(out.withColumn("__len", v.norm(axis)), "__k_", tuple(c / F.col("__len") for c in axis))
        angle = F.get("angles", F.lit(chi - 1))
        turns_here = F.contains(F.try_element_at(moved, F.col("resname")), F.concat(F.lit(","), F.col("atom_name"), F.lit(",")))
        go = turns_here & angle.isNotNull() & F.col("__len").isNotNull()
        # the axis is normalised with a small constant, which shortens the turn a little
        amount = angle * F.col("__len") / (F.col("__len") + F.lit(1e-6))
        new = v.add(v.rotate_about(v.sub(v.vec(), a1), v.vec("__k_"), amount), a1)
        out = out.select(*[c for c in out.columns if c not in XYZ], *[
            F.when(go, n).otherwise(F.col(c)).alias(c) for n, c in zip(new, XYZ)
        ])
        out = out.drop(*[f"__e{e}_{c}" for e in (0, 1) for c in XYZ], "__len", *[f"__k_{c}" for c in XYZ])
    return out.select(*atoms.columns)


def concatenate_chains(backbone: DataFrame, target: str, by=("structure_id",), *, chain="chain", index="pos", padding=10, chain_order="first_line") -> DataFrame:
    """Chains of a structure in one index, target first, blank rows between chains.

    Output adds ``position``; padding rows have null coordinates and residue columns.
    """
    by = list(by)
    heads = backbone.groupBy(*by, chain).agg(F.min(chain_order).alias("__f"), F.count(F.lit(1)).alias("__n"))
    heads = heads.withColumn("__o", F.struct((F.col(chain) != target).alias("t"), F.col("__f")))
    heads = over_groups(heads.withColumn("__w", F.col("__n") + padding), by, ["__o"], __upto=("sum", "__w"), __at=("row_number",))
    heads = heads.withColumn("__from", F.col("__upto") - F.col("__w"))
    numbered = over_groups(backbone, [*by, chain], [index], __i=("row_number",))
    rows = attach(numbered, heads.select(*by, chain, "__from"), [*by, chain], "inner")
    rows = rows.withColumn("position", F.col("__from") + F.col("__i") - 1).drop("__from", "__i")
    blanks = heads.where("__at > 1").select(*by, F.explode(F.sequence(F.col("__from") - padding, F.col("__from") - 1)).alias("position"))
    return rows.unionByName(blanks, allowMissingColumns=True)


def mask_range(backbone: DataFrame, first: int, last: int, *, index="pos", columns=None) -> DataFrame:
    """Null coordinates for a range of positions (both ends included)."""
    columns = columns or [p + c for p in ("n_", "ca_", "c_") for c in XYZ]
    hit = F.col(index).between(first, last)
    return backbone.withColumns({c: F.when(~hit, F.col(c)) for c in columns})
