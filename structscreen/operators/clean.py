"""Atom and residue filters, gap masks, residue order, sequences from structures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structscreen import constants as k
from structscreen.functions.text import one_letter
from structscreen.operators.align import code_points, lists
from structscreen.plans.checks import must_be_empty
from structscreen.plans.skew import attach, over_groups

RESIDUE = ("chain", "hetero", "resid", "insertion")
STRUCTURE = ("structure_id",)


def clean_atoms(atoms: DataFrame, keep_chain: str | None = None) -> DataFrame:
    """Polymer residues only; selenomethionine counts as one; alternate location A or none."""
    out = atoms.where(F.col("hetero").isin(" ", "H_MSE") & F.col("altloc").isin(" ", "", "A"))
    if keep_chain is not None:
        out = out.where(F.col("chain") == keep_chain)
    return out.withColumn("hetero", F.lit(" "))


def drop_elements(atoms: DataFrame, elements=("H", "D"), names=()) -> DataFrame:
    """Atoms of other elements and names; a null element or name is no match and stays."""
    given = lambda c: F.coalesce(c, F.lit(""))
    keep = ~given("element").isin(*elements)
    return atoms.where(keep & ~given("atom_name").isin(*names) if names else keep)


def only_atoms(atoms: DataFrame, names=("CA",)) -> DataFrame:
    return atoms.where(F.col("atom_name").isin(*names))


def filter_residues(
    atoms: DataFrame, by=STRUCTURE, *, standard_only=True, ensure_ca=True,
    bfactor_cutoff: float | None = None, residue=RESIDUE,
) -> DataFrame:
    """Atoms of the residues that pass; the residue test is one aggregate and a semi join."""
    keys = [*by, *residue]
    rows = atoms.where(F.col("hetero") == " ")
    if standard_only:
        rows = rows.where(F.col("resname").isin(*k.THREE_TO_ONE))
    if not ensure_ca and bfactor_cutoff is None:
        return rows
    ca = rows.where("atom_name = 'CA'")
    if bfactor_cutoff is not None:
        ca = ca.where(F.col("b_factor") >= bfactor_cutoff)
    return rows.join(ca.select(*keys).distinct(), keys, "left_semi")


def load_backbone(atoms: DataFrame, by=STRUCTURE, chains: list[str] | None = None, on_missing: str = "error") -> DataFrame:
    """N, CA and C atoms, of some chains if given.

    A structure that lacks one of them is an error; with ``on_missing='keep'`` it simply has the others.
    """
    out = atoms.where(F.col("atom_name").isin("N", "CA", "C") & (F.col("hetero") == " "))
    if chains is None:
        return out
    out = out.where(F.col("chain").isin(*chains))
    if on_missing != "error":
        return out
    has = [F.max(F.when(F.col("chain") == c, True)).alias(f"__c{i}") for i, c in enumerate(chains)]
    found = atoms.select(*by, F.when(F.col("atom_name").isin("N", "CA", "C") & (F.col("hetero") == " "), F.col("chain")).alias("chain")).groupBy(*by).agg(*has)
    lacking = F.concat_ws(",", *[F.when(F.col(f"__c{i}").isNull(), F.lit(c)) for i, c in enumerate(chains)])
    missing = found.where(lacking != "")
    message = F.concat(F.lit("chain not found: "), lacking, F.lit(" in "), F.concat_ws("/", *[F.col(c).cast("string") for c in by]))
    return out.unionByName(must_be_empty(missing, message, out))


def valid_residues(atoms: DataFrame, by=STRUCTURE, residue=RESIDUE) -> DataFrame:
    """Keys of residues that are no water and have N, CA and C."""
    keys = [*by, *residue]
    has = [F.count_if(F.col("atom_name") == a) for a in ("N", "CA", "C")]
    return (
        atoms.where("resname <> 'HOH'").groupBy(*keys)
        .agg(*[h.alias(f"__{i}") for i, h in enumerate(has)])
        .where("__0 > 0 AND __1 > 0 AND __2 > 0").select(*keys)
    )


def residue_index(atoms: DataFrame, by=STRUCTURE, *, order="line_idx", chain="chain", residue=RESIDUE) -> DataFrame:
    """One row per residue in file order with its 0-based index in structure and chain.

    ``chain_offset`` is the number of residues before the chain.
    """
    by = list(by)
    residues = atoms.groupBy(*by, *residue).agg(F.min(order).alias("first_line"), F.first("resname").alias("resname"))
    out = over_groups(residues, by, ["first_line"], residue_idx=("row_number",))
    out = over_groups(out, [*by, chain], ["first_line"], chain_residue_idx=("row_number",))
    out = out.withColumns({
        "residue_idx": F.col("residue_idx") - 1, "chain_residue_idx": F.col("chain_residue_idx") - 1,
    })
    return out.withColumn("chain_offset", F.col("residue_idx") - F.col("chain_residue_idx"))


def mask_positions(masks: DataFrame, by=STRUCTURE, mask="gap_mask") -> DataFrame:
    """(by, pos, drop) for each character of the mask, position from 0."""
    chars = F.split(mask, "")
    chars = F.filter(chars, lambda c: c != "")
    return masks.select(*by, F.posexplode(chars).alias("pos", "__c")).select(
        *by, F.col("pos").cast("long").alias("pos"), (F.col("__c") != "0").alias("drop")
    )


def apply_gap_mask(residues: DataFrame, masks: DataFrame, by=STRUCTURE, *, index="residue_idx", mask="gap_mask") -> DataFrame:
    """Residues whose mask character is '0'; a mask of another length is an error.

    The position runs through the whole structure, over chain borders.
    """
    by = list(by)
    sizes = residues.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    checked = attach(masks.select(*by, mask), sizes, by, "inner").withColumn(
        mask,
        F.when(F.length(mask) == F.col("__n"), F.col(mask)).otherwise(
            F.raise_error(F.lit("gap mask and structure differ in length")).cast("string")
        ),
    )
    kept = mask_positions(checked, by, mask).where(~F.col("drop")).withColumnRenamed("pos", index).drop("drop")
    return residues.join(kept, [*by, index], "left_semi")


def gap_mask_kept(residues, mask) -> Column:
    """``apply_gap_mask`` for a structure in one row: the residues of the array whose mask character is '0'."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keep(ids: pa.Array, masks: pa.Array) -> pa.Array:
        sizes, out = [], [pa.array([], pa.int64())]
        for i, m in zip(ids, masks.to_pylist()):
            if not i.is_valid or m is None:
                sizes.append(None)
                continue
            zero = code_points(m) == 48
            if len(zero) != len(i.values):
                raise ValueError("gap mask and structure differ in length")
            kept = i.values.filter(pa.array(zero))
            sizes.append(len(kept))
            out.append(kept)
        return lists(pa.concat_arrays(out), sizes)

    return keep(residues, mask)


def keep_residues(atoms: DataFrame, ids: DataFrame, keys=("chain", "resid", "insertion"), by=STRUCTURE) -> DataFrame:
    """Atoms of the listed residues; ids of one structure say nothing about another."""
    return attach(atoms, ids.select(*by, *keys).distinct(), [*by, *keys], "left_semi")


def filter_ligands(ligands: DataFrame, max_heavy: int | None = None, single_fragment=True, *, n_heavy="n_heavy", smiles="smiles") -> DataFrame:
    out = ligands
    if max_heavy is not None:
        out = out.where(F.col(n_heavy) <= max_heavy)
    if single_fragment:
        out = out.where(~F.contains(F.col(smiles), F.lit(".")))
    return out


def ligand_names(atoms: DataFrame, by=("structure_id", "chain"), *, n_atoms_thr=10, residue=("hetero", "resid", "insertion")) -> DataFrame:
    """Name of the hetero ligand per chain.

    Water, polymer residues and groups below the atom threshold do not count; one group
    gives its name, several give NAME_natoms in file order; a chain with none gives ''.
    """
    by = list(by)
    groups = (
        atoms.where(~F.col("hetero").isin(" ", "H_MSE", "W")).groupBy(*by, *residue, "resname")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line_idx").alias("first_line"))
        .where(F.col("n") >= n_atoms_thr)
    )
    item = F.struct("first_line", "resname", "n")
    # the value is one text per chain, so its parts meet in one row by definition
    names = groups.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("g")).select(
        *by,
        F.when(F.size("g") == 1, F.col("g")[0]["resname"]).otherwise(
            F.array_join(F.transform("g", lambda x: F.concat_ws("_", x["resname"], x["n"].cast("string"))), ",")
        ).alias("ligand_name"),
    )
    chains = atoms.select(*by).distinct()
    return attach(chains, names, by).withColumn("ligand_name", F.coalesce("ligand_name", F.lit("")))


def structure_sequences(atoms: DataFrame, by=STRUCTURE) -> DataFrame:
    """One sequence per chain from valid residues: label <structure>_chain_<i>.

    Chains are numbered in file order.  A sequence is one text value, so the residues of
    a chain (bounded by the length of a protein) meet in one row.
    """
    by = list(by)
    chains = atoms.groupBy(*by, "chain").agg(F.min("line_idx").alias("__l"))
    chains = over_groups(chains, by, ["__l"], chain_idx=("row_number",)).withColumn(
        "chain_idx", (F.col("chain_idx") - 1).cast("int")
    ).drop("__l")
    keys = [*by, *RESIDUE]
    residues = (
        atoms.join(valid_residues(atoms, by), keys, "left_semi")
        .groupBy(*keys).agg(F.min("line_idx").alias("l"), F.first("resname").alias("resname"))
    )
    letters = residues.select(*by, "chain", F.struct("l", one_letter(F.col("resname")).alias("c")).alias("s"))
    seqs = letters.groupBy(*by, "chain").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["c"]), "").alias("sequence")
    )
    out = attach(chains, seqs, [*by, "chain"]).withColumn("sequence", F.coalesce("sequence", F.lit("")))
    return out.withColumn("label", F.concat(F.concat_ws("_", *by), F.lit("_chain_"), F.col("chain_idx")))


def mean_confidence(atoms: DataFrame, by=STRUCTURE) -> DataFrame:
    """Mean b-factor of all ATOM records: the predicted confidence of a model."""
    return atoms.where("record = 'ATOM'").groupBy(*by).agg(F.avg("b_factor").alias("mean_confidence"))
