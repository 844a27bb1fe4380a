"""V2000 mol blocks as atom and bond tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structscreen.plans.skew import attach, over_groups
from structscreen.sources.lines import id_of, with_line_idx

HEADER_LINES = 4


def _classified(lines: DataFrame, by, repair_counts: bool) -> DataFrame:
    """Tag the lines of a block as atom or bond.

    With ``repair_counts`` the counts line is not trusted: atoms are the unbroken run of
    16-word lines after the header and bonds the run of lines with 7 (or just 4) words behind it.  The runs
    end at the first line that does not fit, found by one aggregate per block.
    """
    by = list(by)
    words = F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != ""))
    body = lines.withColumn("__w", words)
    i = F.col("line_idx")
    if repair_counts:
        atom_end = F.min(F.when((i >= HEADER_LINES) & (F.col("__w") != 16), i)).alias("__atom_end")
        ends = body.groupBy(*by).agg(atom_end, F.max("line_idx").alias("__last"))
        ends = ends.withColumn("__atom_end", F.coalesce("__atom_end", F.col("__last") + 1))
        body = body.join(ends, by)
        bond_end = F.min(F.when((i >= F.col("__atom_end")) & ~F.col("__w").isin(4, 7), i)).alias("__bond_end")
        ends2 = body.groupBy(*by).agg(bond_end)
        body = body.join(ends2, by).withColumn("__bond_end", F.coalesce("__bond_end", F.col("__last") + 1))
    else:
        counts = body.where(i == HEADER_LINES - 1).select(
            *by,
            (F.trim(F.substring("line", 1, 3)).try_cast("int") + HEADER_LINES).alias("__atom_end"),
            F.trim(F.substring("line", 4, 3)).try_cast("int").alias("__nb"),
        )
        body = body.join(counts, by).withColumn("__bond_end", F.col("__atom_end") + F.col("__nb"))
    kind = F.when((i >= HEADER_LINES) & (i < F.col("__atom_end")), F.lit("atom")).when(
        (i >= F.col("__atom_end")) & (i < F.col("__bond_end")), F.lit("bond")
    )
    return body.withColumn("__kind", kind)


def parse_mol_lines(lines: DataFrame, by=("mol_id",), repair_counts=False) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) from numbered lines of one mol block per ``by`` group."""
    by = list(by)
    body = _classified(lines, by, repair_counts)
    i = F.col("line_idx")
    atoms = body.where("__kind = 'atom'").select(
        *by, (i - HEADER_LINES).cast("int").alias("idx"),
        F.trim(F.substring("line", 32, 3)).alias("symbol"),
        *[F.trim(F.substring("line", 1 + 10 * n, 10)).try_cast("double").alias(c) for n, c in enumerate("xyz")],
    )
    bonds = body.where("__kind = 'bond'").select(
        *by,
        (F.trim(F.substring("line", 1, 3)).try_cast("int") - 1).alias("a"),
        (F.trim(F.substring("line", 4, 3)).try_cast("int") - 1).alias("b"),
        F.trim(F.substring("line", 7, 3)).try_cast("int").alias("bond_type"),
    )
    return atoms, bonds


def directed_bonds(bonds: DataFrame, by=("mol_id",)) -> DataFrame:
    """Each bond in both directions, with its type one-hot over the four bond types."""
    from structscreen.constants import BOND_TYPES
    from structscreen.functions.text import one_hot

    ends = F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    ))
    return bonds.select(*by, "bond_type", ends.alias("e")).select(
        *by, "e.src", "e.dst", "bond_type", one_hot(F.col("bond_type"), BOND_TYPES).alias("type_one_hot")
    )


def read_sdf(spark: SparkSession, paths, repair_counts=False, id_pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) of mol files with any number of blocks: keys ``mol_id`` and ``record_idx``.

    Blocks end with ``$$$$``; the block number is a running count of those lines.
    """
    lines = with_line_idx(spark, paths).withColumn("__end", F.startswith("line", F.lit("$$$$")).cast("int"))
    counted = over_groups(lines, ["file"], ["line_idx"], split=True, __ends=("sum", "__end"))
    blocks = counted.withColumn("record_idx", (F.col("__ends") - F.col("__end")).cast("int"))
    start = blocks.groupBy("file", "record_idx").agg(F.min("line_idx").alias("__start"))
    placed = attach(blocks, start, ["file", "record_idx"])
    body = placed.select(id_of(F.col("file"), id_pattern).alias("mol_id"), "record_idx", (F.col("line_idx") - F.col("__start")).alias("line_idx"), "line")
    return parse_mol_lines(body, ("mol_id", "record_idx"), repair_counts)
