"""Rotatable bonds and rotation masks of many molecules at once.

A spanning tree is built by joining components, each over its least bond; its Euler tour is numbered by pointer doubling.
So the number of rounds grows with the logarithm of the number of atoms, and every table has a row per atom or bond.
The numbers of the atoms in tour order (``place``) make the part under a bond an interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structscreen.plans.skew import attach, cut_lineage


def _both_ways(bonds: DataFrame, by, one: str, two: str) -> DataFrame:
    """(by, src, dst): every bond in both directions."""
    ways = F.array(F.struct(F.col(one).alias("src"), F.col(two).alias("dst")), F.struct(F.col(two).alias("src"), F.col(one).alias("dst")))
    return bonds.select(*by, F.explode(ways).alias("e")).select(*by, "e.src", "e.dst")


def _followed(links: DataFrame, by) -> DataFrame:
    """(by, at, to): pointers followed to the end; an end points to itself.  A round takes four times as many steps as the one before."""
    while True:
        for _ in range(2):
            on = links.select(*by, F.col("at").alias("to"), F.col("to").alias("__far"))
            links = links.join(on, [*by, "to"]).select(*by, "at", F.col("__far").alias("to"), (F.col("to") != F.col("__far")).alias("__moved"))
        links = cut_lineage(links)
        if links.where("__moved").isEmpty():
            return links.select(*by, "at", "to")


def spanning_edges(bonds: DataFrame, by=("mol_id",)) -> DataFrame:
    """(by, lo, hi, part): bonds that form a tree of every connected part."""
    by = list(by)
    edges = cut_lineage(bonds.select(*by, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct())
    parts = cut_lineage(_both_ways(edges, by, "lo", "hi").select(*by, F.col("src").alias("atom")).distinct().withColumn("part", F.col("atom")))
    chosen = edges.limit(0)
    while True:
        one = parts.select(*by, F.col("atom").alias("lo"), F.col("part").alias("p"))
        two = parts.select(*by, F.col("atom").alias("hi"), F.col("part").alias("q"))
        between = edges.join(one, [*by, "lo"]).join(two, [*by, "hi"]).where("p <> q")
        ways = F.explode(F.array(F.struct(F.col("p").alias("at"), F.col("q").alias("to")), F.struct(F.col("q").alias("at"), F.col("p").alias("to"))))
        least = between.select(*by, "lo", "hi", ways.alias("w")).groupBy(*by, F.col("w.at").alias("at")).agg(F.min(F.struct("lo", "hi", F.col("w.to").alias("to"))).alias("m"))
        picked = cut_lineage(least.select(*by, "at", "m.lo", "m.hi", "m.to"))
        if picked.isEmpty():
            return chosen.join(parts.select(*by, F.col("atom").alias("lo"), "part"), [*by, "lo"])
        chosen = cut_lineage(chosen.unionByName(picked.select(*by, "lo", "hi").distinct()))
        # two parts that picked each other: the smaller one stays
        back = picked.select(*by, F.col("at").alias("to"), F.col("to").alias("__back"))
        all_parts = parts.select(*by, F.col("part").alias("at")).distinct()
        joined = attach(all_parts, picked.join(back, [*by, "to"]).select(*by, "at", "to", "__back"), [*by, "at"])
        stays = F.col("to").isNull() | ((F.col("__back") == F.col("at")) & (F.col("at") < F.col("to")))
        ends = _followed(joined.select(*by, "at", F.when(stays, F.col("at")).otherwise(F.col("to")).alias("to")), by)
        parts = cut_lineage(parts.join(ends.select(*by, F.col("at").alias("part"), F.col("to").alias("__p")), [*by, "part"]).select(*by, "atom", F.col("__p").alias("part")))


def spanning_tree(bonds: DataFrame, by=("mol_id",)) -> DataFrame:
    """A tree of each molecule from its smallest atom: (by, atom, parent, place, below, total).

    ``place`` counts the atoms from 0 in the order of a walk around the tree; the ``below`` atoms from ``place`` on are those
    under the bond to ``parent``.  ``total`` atoms are in the molecule; of one that is not connected, the part of the smallest atom counts.
    """
    by = list(by)
    edges = spanning_edges(bonds, by)
    main = edges.groupBy(*by).agg(F.min_by("part", "lo").alias("part"))
    arcs = _both_ways(edges.join(main, [*by, "part"], "left_semi"), by, "lo", "hi")
    around = Window.partitionBy(*by, "src").orderBy("dst")
    root = F.min("src").over(Window.partitionBy(*by))
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = arcs.withColumns({"__next": F.lead("dst").over(around), "__first": F.min("dst").over(whole), "__root": root})
    # behind the arc to an atom comes its next way out; the tour ends where the root has none left
    after = F.when(F.col("__next").isNotNull(), F.col("__next")).when(F.col("src") != F.col("__root"), F.col("__first"))
    tour = turns.select(*by, F.col("dst").alias("u"), F.col("src").alias("v"), F.when(after.isNotNull(), F.col("src")).alias("nu"), after.alias("nv"), F.lit(1).alias("left"))
    tour = cut_lineage(tour)
    while not tour.where("nu IS NOT NULL").isEmpty():
        for _ in range(2):  # a round takes four times as many steps as the one before
            on = tour.select(*by, F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("__u"), F.col("nv").alias("__v"), F.col("left").alias("__left"))
            tour = tour.join(on, [*by, "nu", "nv"], "left").select(
                *by, "u", "v", F.col("__u").alias("nu"), F.col("__v").alias("nv"), (F.col("left") + F.coalesce("__left", F.lit(0))).alias("left")
            )
        tour = cut_lineage(tour)
    back = tour.select(*by, F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("__back"))
    down = tour.join(back, [*by, "u", "v"]).where(F.col("left") > F.col("__back"))
    lower = down.select(*by, F.col("v").alias("atom"), F.col("u").alias("parent"), "left", ((F.col("left") - F.col("__back") + 1) / 2).cast("long").alias("below"))
    top = lower.groupBy(*by).agg(F.min(F.least("atom", "parent")).alias("atom"), F.max("left").alias("left"), (F.count(F.lit(1)) + 1).alias("below"))
    top = top.select(*by, "atom", F.lit(None).cast(lower.schema["parent"].dataType).alias("parent"), (F.col("left") + 1).alias("left"), "below")
    order, all_of = Window.partitionBy(*by).orderBy(F.col("left").desc()), Window.partitionBy(*by)
    return lower.unionByName(top).select(*by, "atom", "parent", (F.row_number().over(order) - 1).cast("long").alias("place"), "below", F.max("below").over(all_of).alias("total"))


def bond_sides(bonds: DataFrame, by=("mol_id",), tree: DataFrame | None = None) -> DataFrame:
    """Bonds whose removal splits their molecule, with the sizes of both sides.

    A tree bond splits the molecule exactly when no other bond leaves the subtree below
    it.  Every other bond marks both its ends with the same two 64-bit hashes; a mark that
    stays inside the subtree cancels in the XOR over it, which is that of two running XORs in the order of the walk.
    Output: by, atom (the lower end), parent, place, below (atoms under the bond), total.
    """
    by = list(by)
    tree = tree if tree is not None else cut_lineage(spanning_tree(bonds, by))
    pair = bonds.select(*by, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    tree_pairs = tree.where("parent IS NOT NULL").select(*by, F.least("atom", "parent").alias("lo"), F.greatest("atom", "parent").alias("hi"))
    extra = pair.join(tree_pairs, [*by, "lo", "hi"], "left_anti")
    tags = extra.select(
        *by, F.explode(F.array("lo", "hi")).alias("atom"),
        F.xxhash64(*by, "lo", "hi").alias("h1"), F.xxhash64("hi", F.lit(17), "lo", *by).alias("h2"),
    ).groupBy(*by, "atom").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    upto = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = {f"x{k}": F.bit_xor(F.coalesce(f"h{k}", F.lit(0))).over(upto) for k in (1, 2)}
    marked = attach(tree, tags, [*by, "atom"]).withColumns(run)
    ends = marked.select(*by, F.col("place").alias("__end"), F.col("x1").alias("__x1"), F.col("x2").alias("__x2"))
    low = marked.where("parent IS NOT NULL").withColumn("__end", F.col("place") + F.col("below") - 1).join(ends, [*by, "__end"])
    own = {k: F.col(f"x{k}").bitwiseXOR(F.coalesce(f"h{k}", F.lit(0))) for k in (1, 2)}  # up to the atom before
    return low.where((F.col("__x1") == own[1]) & (F.col("__x2") == own[2])).select(*by, "atom", "parent", "place", "below", "total")


def rotatable_bonds(bonds: DataFrame, by=("mol_id",), *, single=1, tree: DataFrame | None = None) -> DataFrame:
    """Single bonds that split the molecule into parts of at least two atoms.

    Output: by, atom, parent, smaller (size of the smaller part), turns_below (the part
    under ``atom`` is the smaller one; of equal parts the one with the first atom counts), and
    place, below and total of the tree.
    Molecules are to be connected (``filter_ligands`` drops the others).
    """
    by = list(by)
    sides = bond_sides(bonds, by, tree)
    kinds = bonds.select(*by, F.least("a", "b").alias("__lo"), F.greatest("a", "b").alias("__hi"), "bond_type")
    sides = sides.withColumns({"__lo": F.least("atom", "parent"), "__hi": F.greatest("atom", "parent")})
    typed = sides.join(kinds, [*by, "__lo", "__hi"], "inner").where(F.col("bond_type") == single)
    other = F.col("total") - F.col("below")
    typed = typed.withColumns({"smaller": F.least("below", other), "turns_below": F.col("below") < other})
    return typed.where(F.col("smaller") >= 2).select(*by, "atom", "parent", "smaller", "turns_below", "place", "below", "total")


def torsion_atoms(bonds: DataFrame, rotatable: DataFrame, by=("mol_id",)) -> DataFrame:
    """Four atoms of each rotatable bond: first other neighbour at both ends.

    ``bonds`` needs ``bond_idx``, which gives the neighbour order.
    """
    by = list(by)
    links = F.explode(F.array(
        F.struct(F.col("a").alias("at"), F.col("b").alias("to"), "bond_idx"), F.struct(F.col("b").alias("at"), F.col("a").alias("to"), "bond_idx")
    ))
    near = bonds.select(*by, links.alias("e")).select(*by, "e.*")

    def first_other(end, away, out):
        ends = rotatable.select(*by, "atom", "parent", F.col(end).alias("at"), F.col(away).alias("__away"))
        j = ends.join(near, [*by, "at"], "inner").where(F.col("to") != F.col("__away"))
        return j.groupBy(*by, "atom", "parent").agg(F.min_by("to", "bond_idx").alias(out))

    out = attach(rotatable, first_other("parent", "atom", "before"), [*by, "atom", "parent"])
    return attach(out, first_other("atom", "parent", "after"), [*by, "atom", "parent"]).select(
        *by, "before", F.col("parent").alias("start"), F.col("atom").alias("end"), "after"
    )


def rotation_masks(bonds: DataFrame, by=("mol_id",), *, single=1) -> DataFrame:
    """Atoms that move with each rotatable bond: (by, src, dst, atom), dst in the moving part.

    The moving part is an interval of places, or what lies beside one; a row is made for each of its atoms only.
    """
    by = list(by)
    tree = cut_lineage(spanning_tree(bonds, by))
    rot = rotatable_bonds(bonds, by, single=single, tree=tree)
    end = F.col("place") + F.col("below")
    empty = F.array().cast("array<bigint>")
    steps = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(empty)
    inside, outside = steps(F.col("place"), end - 1), F.concat(steps(F.lit(0).cast("long"), F.col("place") - 1), steps(end, F.col("total") - 1))
    moved = rot.select(
        *by, F.when(F.col("turns_below"), F.col("parent")).otherwise(F.col("atom")).alias("src"),
        F.when(F.col("turns_below"), F.col("atom")).otherwise(F.col("parent")).alias("dst"), F.explode(F.when(F.col("turns_below"), inside).otherwise(outside)).alias("place"),
    )
    return moved.join(tree.select(*by, "place", "atom"), [*by, "place"]).select(*by, "src", "dst", "atom")
