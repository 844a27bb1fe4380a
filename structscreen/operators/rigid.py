"""Rigid fits from sums, and applying transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structscreen.functions import vec as v
from structscreen.operators.spatial import XYZ, pocket_atoms
from structscreen.plans.skew import attach


def rmsd(pairs: DataFrame, by=(), a="a_", b="b_", out="rmsd") -> DataFrame:
    return pairs.groupBy(*by).agg(F.sqrt(F.avg(v.dist2(v.vec(a), v.vec(b)))).alias(out))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rotation(h: pd.Series, repair: pd.Series) -> pd.Series:
    """Row-major rotations R = V U^T from 3x3 covariances, one batched decomposition."""
    if len(h) == 0:
        return pd.Series([], dtype=object)
    m = np.vstack(h.to_numpy()).astype(float).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(m)
    r = np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)
    flip = (np.linalg.det(r) < 0) & repair.to_numpy().astype(bool)
    vt[flip, 2, :] *= -1
    r = np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)
    return pd.Series(list(r.reshape(-1, 9)))


def kabsch(pairs: DataFrame, by=(), *, a="a_", b="b_", reflect_fix=True, repartition_sums=True) -> DataFrame:
    """Least-squares rotation and translation taking points ``a`` to points ``b``.

    One grouped pass collects sums only (counts, coordinate sums, nine products), with
    partial sums before the shuffle; the 3x3 decomposition works on one row per group.
    Output: by, n, r (row-major, column form b = R a + t), t, rmsd after the fit.
    Coordinates are taken relative to the first-order sums, so structures far from the
    origin lose no more than the usual digits of a two-moment variance.
    """
    by = list(by)
    pa, pb = v.vec(a), v.vec(b)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"__a{i}") for i, c in enumerate(pa)]
    aggs += [F.avg(c).alias(f"__b{i}") for i, c in enumerate(pb)]
    aggs += [F.covar_pop(pa[i], pb[j]).alias(f"__h{i}{j}") for i in range(3) for j in range(3)]
    aggs += [sum((F.var_pop(c) for c in (*pa, *pb)), F.lit(0.0)).alias("__spread")]
    sums = pairs.groupBy(*by).agg(*aggs)
    h = F.array(*[F.col(f"__h{i}{j}") for i in range(3) for j in range(3)])
    fit = sums.withColumn("__h", h).withColumn("r", _rotation("__h", F.lit(reflect_fix)))
    ca, cb = (tuple(F.col(f"__{s}{i}") for i in range(3)) for s in "ab")
    turned = v.matrix_times_column(F.col("r"), ca)
    fit = fit.withColumn("t", F.array(*v.sub(cb, turned)))
    # trace of R^T H' with H'_ij = cov(b_i, a_j): what the best rotation gains
    gain = sum((F.col("r")[3 * i + j] * F.col(f"__h{j}{i}") for i in range(3) for j in range(3)), F.lit(0.0))
    left = F.col("__spread") - F.lit(2.0) * gain
    return fit.withColumn("rmsd", F.sqrt(F.greatest(left, F.lit(0.0)))).select(*by, "n", "r", "t", "rmsd")


def kabsch_rmsd(pairs: DataFrame, by=(), *, a="a_", b="b_", return_transform=False) -> DataFrame:
    """Fitted RMSD without reflection repair, as the plain fit is defined."""
    fit = kabsch(pairs, by, a=a, b=b, reflect_fix=False)
    return fit if return_transform else fit.select(*by, "n", "rmsd")


def apply_transform(points: DataFrame, transforms: DataFrame, by=(), *, prefix="", form="column") -> DataFrame:
    """Move points by the transform of their group: R x + t, or x R + t in row form."""
    joined = attach(points, transforms.select(*by, "r", "t"), by, "inner")
    p, r = v.vec(prefix), F.col("r")
    moved = v.matrix_times_column(r, p) if form == "column" else v.row_times_matrix(p, r)
    moved = tuple(m + F.col("t")[i] for i, m in enumerate(moved))
    return v.with_vec(joined.select("*", *[c.alias(f"__m{i}") for i, c in enumerate(moved)]), prefix,
                      tuple(F.col(f"__m{i}") for i in range(3))).drop("__m0", "__m1", "__m2", "r", "t")


def align_to_reference(
    ref_ca: DataFrame, ref_ligand: DataFrame, model_ca: DataFrame, model_atoms: DataFrame,
    model_ligand: DataFrame, by=("pose_id",), *, index="residue_idx", radius=15.0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Superpose model on reference by the C-alphas near the reference ligand.

    The pocket is every reference C-alpha closer than ``radius`` to the ligand's
    centroid.  Masked residues are to be dropped from both C-alpha tables before
    (``apply_gap_mask``).  Returns moved protein atoms, moved ligand, and the fits.
    """
    by = list(by)
    pocket = pocket_atoms(ref_ca, ref_ligand, radius, by, around="centroid", id_col=index)
    pairs = model_ca.select(*by, index, *[F.col(c).alias(f"a_{c}") for c in XYZ]).join(
        pocket.select(*by, index, *[F.col(c).alias(f"b_{c}") for c in XYZ]), [*by, index], "inner"
    )
    fits = kabsch(pairs, by)
    return apply_transform(model_atoms, fits, by), apply_transform(model_ligand, fits, by), fits


def match_atoms(
    ref: DataFrame, model: DataFrame, by=("pose_id",), *, index="residue_idx", atom="atom_name",
) -> tuple[DataFrame, DataFrame]:
    """Reference atoms with their model partner by residue position and atom name.

    Residues pair by position and the shorter side ends the pairing, which an inner join
    on the position gives.  Second result per group: heavy reference atoms without a
    partner, with a warning flag above ten.
    """
    by = list(by)
    keys = [*by, index, atom]
    model_res = model.select(*by, index).distinct()
    r = ref.join(model_res, [*by, index], "left_semi")
    joined = r.select(*keys, F.col("element").alias("__el"), *[c for c in ref.columns if c not in (*keys, *XYZ, "element")],
                      *[F.col(c).alias(f"a_{c}") for c in XYZ]).join(
        model.select(*keys, *[F.col(c).alias(f"b_{c}") for c in XYZ], F.lit(1).alias("__hit")), keys, "left"
    )
    missed = F.count_if(F.col("__hit").isNull() & ~F.col("__el").isin("H", "D"))
    report = joined.groupBy(*by).agg(missed.alias("unmatched"), F.count("__hit").alias("matched"))
    report = report.withColumn("suspicious", F.col("unmatched") > 10)
    return joined.where("__hit = 1").withColumnRenamed("__el", "element").drop("__hit"), report


def protein_rmsd(pairs: DataFrame, ligand: DataFrame, by=("pose_id",), *, id_col="atom_idx", radius=5.0) -> DataFrame:
    """Protein RMSD and the RMSD of the atoms whose reference place is near the ligand.

    ``pairs`` has a_* (reference) and b_* (model).  No near atom: pocket_rmsd is -1.
    """
    by = list(by)
    from structscreen.operators.spatial import near_any

    points = pairs.select(*by, id_col, *[F.col(f"a_{c}").alias(c) for c in XYZ])
    near = near_any(points, ligand, radius, by, id_col=id_col).withColumn("__near", F.lit(True))
    d2 = v.dist2(v.vec("a_"), v.vec("b_"))
    flagged = attach(pairs, near, [*by, id_col])
    return flagged.groupBy(*by).agg(
        F.sqrt(F.avg(d2)).alias("protein_rmsd"),
        F.coalesce(F.sqrt(F.avg(F.when(F.col("__near"), d2))), F.lit(-1.0)).alias("pocket_rmsd"),
    )


def center_of_mass(atoms: DataFrame, by=(), symbol="symbol") -> DataFrame:
    """Mass-weighted centre; an unknown element fails the job."""
    from structscreen.constants import ATOMIC_MASS
    from structscreen.functions.text import literal_map

    m = F.try_element_at(literal_map(ATOMIC_MASS), F.upper(symbol))
    m = F.coalesce(m, F.raise_error(F.concat(F.lit("unknown element "), F.col(symbol))).cast("double"))
    with_m = atoms.withColumn("__m", m)
    return with_m.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("__m")) / F.sum("__m")).alias(c) for c in XYZ])


def centroid(points: DataFrame, by=(), out=XYZ) -> DataFrame:
    return points.groupBy(*by).agg(*[F.avg(c).alias(o) for c, o in zip(XYZ, out)])


def center_on(points: DataFrame, reference: DataFrame, by=()) -> DataFrame:
    """Coordinates relative to the centroid of ``reference``; the centre stays as center_*."""
    centre = centroid(reference, by, tuple(f"center_{c}" for c in XYZ))
    joined = attach(points, centre, by, "inner")
    return v.with_vec(joined, "", v.sub(v.vec(), v.vec("center_")))


def complex_statistics(receptor: DataFrame, ligand: DataFrame, by=("complex_id",), matching: str | None = None) -> DataFrame:
    """mean, population deviation and maximum over complexes of four sizes.

    Coordinates are centred on the protein.  ``matching`` names a per-complex matching
    RMSD on the ligand table; without it that statistic is 0.
    """
    by = list(by)
    far = receptor.groupBy(*by).agg(F.max(v.norm(v.vec())).alias("radius_protein"))
    mid = centroid(ligand, by, ("mx", "my", "mz"))
    lig = attach(ligand, mid, by, "inner").groupBy(*by).agg(
        F.max(v.dist(v.vec(), tuple(F.col(f"m{c}") for c in XYZ))).alias("radius_molecule"),
        F.max(v.norm(tuple(F.col(f"m{c}") for c in XYZ))).alias("center_distance"),
        (F.max(matching) if matching else F.lit(0.0)).alias("rmsd_matching"),
    )
    per = attach(far, lig, by, "inner")
    names = ("radius_protein", "radius_molecule", "center_distance", "rmsd_matching")
    rows = per.select(F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("v")) for n in names])).alias("s"))
    return rows.groupBy(F.col("s.statistic").alias("statistic")).agg(
        F.avg("s.v").alias("mean"), F.stddev_pop("s.v").alias("std"), F.max("s.v").alias("max")
    )
