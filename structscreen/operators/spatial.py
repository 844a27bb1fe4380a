"""Distance joins.

Pairs closer than a radius are found with a grid: space is cut into cubes of the
radius, one side is copied to the 27 cubes around each point, the two sides meet in an
equi-join on (group, cube), and the exact distance decides.  There is no all-pairs step;
a very large group spreads over as many keys as it has occupied cubes, and a crowded
cube is split by the skew join of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structscreen.functions import vec as v
from structscreen.plans.checks import must_be_empty
from structscreen.plans.skew import attach, cut_lineage, over_groups

XYZ = ("x", "y", "z")


_AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
# own cube first, then one of each pair of opposite neighbours: enough for unordered pairs
_HALF = sorted(o for o in _AROUND if o >= (0, 0, 0))
_BITS = 21


def _cube(xyz, side: Column, origin=None, step: Column | None = None) -> Column:
    """Cube of a point as one long: 21 low bits of each cube number.

    Numbers that wrap around can only add candidates, which the exact distance removes;
    the neighbours of one cube never share a key.
    """
    mask = F.lit((1 << _BITS) - 1).cast("long")
    key = None
    for n, c in enumerate(xyz):
        at = F.floor((F.col(c) if origin is None else F.col(c) - origin[n]) / side)
        part = F.shiftleft((at if step is None else at + step[n]).bitwiseAND(mask), (2 - n) * _BITS)
        key = part if key is None else key.bitwiseOR(part)
    return key


def _spread_cubes(df: DataFrame, xyz, side: Column, offsets, origin=None) -> DataFrame:
    """One copy per neighbouring cube: adds ``__o`` (number of the neighbour) and ``__cube``."""
    steps = F.array(*[F.array(*[F.lit(i) for i in o]) for o in offsets])  # a constant
    copies = df.select("*", F.posexplode(steps).alias("__o", "__step"))
    return copies.withColumn("__cube", _cube(xyz, side, origin, F.col("__step"))).drop("__step")


def _within_reach(df: DataFrame, xyz, radius: Column, side: Column, offsets) -> DataFrame:
    """``_spread_cubes`` to the neighbours that a point's radius reaches; a little more than the radius, for rounding."""
    def sides(c):
        at, reach = F.floor(F.col(c) / side), radius * (1 + 1e-9) + F.abs(F.col(c)) * 1e-12
        return F.struct((F.floor((F.col(c) - reach) / side) < at).alias("low"), (F.floor((F.col(c) + reach) / side) > at).alias("high"))

    near = df.withColumns({f"__s{n}": sides(c) for n, c in enumerate(xyz)})
    steps = F.array(*[F.array(*[F.lit(i) for i in o]) for o in offsets])  # a constant
    copies = near.select("*", F.posexplode(steps).alias("__o", "__step"))
    for n in range(len(xyz)):
        step = F.col("__step")[n]
        copies = copies.where((step == 0) | ((step < 0) & F.col(f"__s{n}.low")) | ((step > 0) & F.col(f"__s{n}.high")))
    return copies.withColumn("__cube", _cube(xyz, side, None, F.col("__step"))).drop("__step", *[f"__s{n}" for n in range(len(xyz))])


def radius_join(
    a: DataFrame, b: DataFrame, radius, by=(), *, a_cols=(), b_cols=(), xyz=XYZ,
    strict=True, prefixes=("a_", "b_"),
) -> DataFrame:
    """All pairs (one row of ``a``, one of ``b``) of a group with distance below ``radius``.

    ``radius`` is a number, or the name of a column that both sides carry with one value
    per group; then the test is distance / radius <= 1 (not strict).  Give the smaller
    side as ``b``: it is the one copied to the neighbouring cubes.  Output: the group
    columns, ``a_*``, ``b_*`` and ``distance``.
    """
    by, pa, pb = list(by), *prefixes
    if isinstance(radius, str):
        a_cols, b_cols = [*a_cols, radius], [*b_cols, radius]
        side_col = F.col(radius)
        near = F.sqrt("__d2") / F.col(pa + radius) <= 1
    else:
        side_col = F.lit(float(radius))
        near = F.col("__d2") < side_col * side_col if strict else F.col("__d2") <= side_col * side_col
    left = a.select(
        *by, _cube(xyz, side_col).alias("__cube"), *[F.col(c).alias(pa + c) for c in dict.fromkeys([*a_cols, *xyz])]
    )
    right = _spread_cubes(b.select(*dict.fromkeys([*by, *b_cols, *xyz])), xyz, side_col, _AROUND).select(
        *by, "__cube", *[F.col(c).alias(pb + c) for c in dict.fromkeys([*b_cols, *xyz])]
    )
    keys = by + ["__cube"]
    d2 = v.dist2(tuple(F.col(pa + c) for c in xyz), tuple(F.col(pb + c) for c in xyz))
    return (
        left.join(right, keys, "inner")
        .withColumn("__d2", d2)
        .where(near)
        .withColumn("distance", F.sqrt("__d2"))
        .drop("__cube", "__d2")
    )


def radius_pairs(
    points: DataFrame, radius, by=(), *, id_col: str, cols=(), xyz=XYZ, strict=True,
    prefixes=("a_", "b_"), side: float = 1.0,
) -> DataFrame:
    """Unordered self pairs (a id < b id) of a group with distance below ``radius``.

    Only half of the neighbouring cubes are visited; a pair from two cubes is turned
    afterwards so that the smaller id stands first.  ``side`` is the side of a cube in radii, one or more: a
    point is copied only to the cubes that its radius reaches, so thin points travel far less with larger
    cubes (at 4 about 2 copies in place of 14) and measure more candidates.
    """
    by, pa, pb = list(by), *prefixes
    r = F.lit(float(radius))
    cols = list(dict.fromkeys([id_col, *cols, *xyz]))
    width = F.lit(float(radius) * side)
    left = points.select(*by, _cube(xyz, width).alias("__cube"), *[F.col(c).alias(f"__l_{c}") for c in cols])
    right = _within_reach(points.select(*dict.fromkeys([*by, *cols])), xyz, r, width, _HALF).select(
        *by, "__cube", "__o", *[F.col(c).alias(f"__q_{c}") for c in cols]
    )
    lid, qid = F.col(f"__l_{id_col}"), F.col(f"__q_{id_col}")
    d2 = v.dist2(tuple(F.col(f"__l_{c}") for c in xyz), tuple(F.col(f"__q_{c}") for c in xyz))
    limit = r * r
    pairs = (
        left.join(right, by + ["__cube"], "inner")
        .where((F.col("__o") > 0) | (lid < qid))
        .withColumn("__d2", d2)
        .where(F.col("__d2") < limit if strict else F.col("__d2") <= limit)
    )
    in_order = lid < qid
    return pairs.select(
        *by,
        *[F.when(in_order, F.col(f"__l_{c}")).otherwise(F.col(f"__q_{c}")).alias(pa + c) for c in cols],
        *[F.when(in_order, F.col(f"__q_{c}")).otherwise(F.col(f"__l_{c}")).alias(pb + c) for c in cols],
        F.sqrt("__d2").alias("distance"),
    )


def both_directions(pairs: DataFrame, prefixes=("a_", "b_")) -> DataFrame:
    """Turn unordered pairs into directed ones (each pair twice), without a shuffle."""
    pa, pb = prefixes
    base = [c[len(pa):] for c in pairs.columns if c.startswith(pa)]
    rest = [c for c in pairs.columns if not (c.startswith(pa) or c.startswith(pb))]
    one = F.struct(*[F.col(pa + c) for c in base], *[F.col(pb + c) for c in base])
    two = F.struct(
        *[F.col(pb + c).alias(pa + c) for c in base], *[F.col(pa + c).alias(pb + c) for c in base]
    )
    return pairs.withColumn("__e", F.explode(F.array(one, two))).select(*rest, "__e.*")


def radius_graph(
    points: DataFrame, radius, by=(), *, id_col: str, cols=(), directed=True,
    max_neighbors: int | None = None, xyz=XYZ, strict=True,
) -> DataFrame:
    """Self pairs within ``radius``; directed edges can be capped to the nearest k."""
    pairs = radius_pairs(points, radius, by, id_col=id_col, cols=cols, xyz=xyz, strict=strict)
    if not directed:
        return pairs
    edges = both_directions(pairs)
    if max_neighbors is None:
        return edges
    w = Window.partitionBy(*by, f"a_{id_col}").orderBy("distance", f"b_{id_col}")
    return edges.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_neighbors).drop("__n")


def neighbor_graph(
    points: DataFrame, cutoff, k: int, by=(), *, id_col: str, cols=(), xyz=XYZ,
    on_isolated: str = "error",
) -> DataFrame:
    """Edges to all neighbours within ``cutoff``, or to the ``k`` nearest if there are more.

    A point without neighbours is an error: the result then raises when it is computed
    (``on_isolated='error'``); with ``'keep'`` such points simply have no edges.
    """
    edges = radius_graph(points, cutoff, by, id_col=id_col, cols=cols, max_neighbors=k, xyz=xyz)
    if on_isolated != "error":
        return edges
    linked = edges.select(*by, F.col(f"a_{id_col}").alias(id_col), F.lit(1).alias("__ok")).distinct()
    alone = attach(points.select(*by, id_col), linked, [*by, id_col], "left").where("__ok IS NULL")
    message = F.concat(F.lit("isolated point "), F.col(id_col).cast("string"))
    return edges.unionByName(must_be_empty(alone, message, edges))


# ------------------------------------------------------------------- nearest neighbours
def _spread_bits(value: Column) -> Column:
    """The low 21 bits of a long, two zero bits after each."""
    def step(shift: int, mask: int):
        return lambda x: x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))

    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        value = F.transform(F.array(value), step(shift, mask))[0]  # a lambda variable is evaluated once however often it is used
    return value


def _order_along_curve(df: DataFrame, xyz, origin, span: Column) -> DataFrame:
    """Add ``__z0 __z1 __z2``: place on a Z-curve through the table's cube, 51 bits per coordinate, which is all that a double holds."""
    whole = [F.least(F.floor((F.col(c) - o) / span * F.lit(float(1 << 51))), F.lit((1 << 51) - 1)) for c, o in zip(xyz, origin)]
    out = {}
    for part in range(3):
        bits = [_spread_bits(F.shiftright(w, 17 * (2 - part)).bitwiseAND(F.lit((1 << 17) - 1))) for w in whole]
        out[f"__z{part}"] = F.shiftleft(bits[0], 2).bitwiseOR(F.shiftleft(bits[1], 1)).bitwiseOR(bits[2])
    return df.withColumns(out)


_CURVE = ("__z0", "__z1", "__z2")


def _in_pieces(df: DataFrame, by) -> DataFrame:
    """Rows dealt out by group and place on the curve; ``__piece`` tells pieces of a group apart.

    A group of any size becomes many pieces.  Where the borders fall changes nothing but how tight a bound is.
    """
    return df.repartitionByRange(*by, *_CURVE).withColumn("__piece", F.spark_partition_id())


def _reaches(q: DataFrame, pts: DataFrame, by, need: int, xyz) -> DataFrame:
    """Queries with ``__reach``: a distance within which ``need`` points lie, null if the piece of the curve has too few.

    A point has ``need`` points (itself included) within the ``need``-th distance to its neighbours on the curve; a query has
    them within that and its distance to the point before or behind it.
    """
    here = F.struct(*xyz)
    along = Window.partitionBy(*by, "__piece").orderBy(*_CURVE)
    known = _in_pieces(pts, by).withColumn("__near", F.collect_list(here).over(along.rowsBetween(-need, need)))
    distances = F.transform("__near", lambda p: F.sqrt(sum((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in xyz)))
    known = known.withColumn("__r", F.try_element_at(F.array_sort(distances), F.lit(need)))
    mark = F.when(F.col("__r").isNotNull(), F.struct(*xyz, "__r"))
    rows = known.select(*by, *xyz, *_CURVE, mark.alias("__p"), F.lit(None).cast(q.schema["__q"].dataType).alias("__q"), F.lit(False).alias("__asks")).unionByName(
        q.select(*by, *xyz, *_CURVE, F.lit(None).cast(known.select(mark.alias("p")).schema["p"].dataType).alias("__p"), "__q", F.lit(True).alias("__asks"))
    )
    back = Window.partitionBy(*by, "__piece").orderBy(*[F.col(c).desc() for c in _CURVE]).rowsBetween(Window.unboundedPreceding, 0)
    sides = {"__a": F.last("__p", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)), "__b": F.last("__p", ignorenulls=True).over(back)}
    told = _in_pieces(rows, by).withColumns(sides).where("__asks")

    def within(side: str) -> Column:
        return F.sqrt(sum((F.col(side)[c] - F.col(c)) * (F.col(side)[c] - F.col(c)) for c in xyz)) + F.col(side)["__r"]

    return told.select(*by, "__q", *xyz, (F.least(within("__a"), within("__b")) * F.lit(1 + 1e-9)).alias("__reach"))


def knn_candidates(queries: DataFrame, points: DataFrame, k: int, by, *, q_id: str, p_id: str, xyz=XYZ, exclude_same_id=False, p_cols=()) -> DataFrame:
    """(by, __q, query place, __reach, p_id, p_cols): the points that ``knn_join`` measures, a few times ``k`` per query."""
    by = list(by)
    need = k + (1 if exclude_same_id else 0)
    p_cols = [c for c in dict.fromkeys([*p_cols, *xyz]) if c != p_id]
    w_same = Window.partitionBy(*by, *xyz).orderBy(p_id)
    pts = points.select(*by, p_id, *p_cols).withColumn("__n", F.row_number().over(w_same)).where(F.col("__n") <= need).drop("__n")
    both = queries.select(*xyz).unionByName(points.select(*xyz))
    extent = both.agg(*[F.min(c).alias(c) for c in xyz], F.greatest(*[F.max(c) - F.min(c) for c in xyz]).alias("span")).first()
    span = (extent["span"] or 0.0) * (1 + 1e-9) + 1e-9
    origin = [F.lit(extent[c]) for c in xyz]
    curve = lambda df: _order_along_curve(df, xyz, origin, F.lit(span))
    q = queries.select(*by, F.col(q_id).alias("__q"), *xyz)
    # kept as a table: where pieces end differs from run to run, and with it a reach
    reached = cut_lineage(_reaches(curve(q).select(*by, "__q", *xyz, *_CURVE), curve(pts).select(*by, *xyz, *_CURVE), by, need, xyz))
    # the finest grid whose cubes are no smaller than the reach; a double tells no more than 50 levels apart
    reach = F.greatest(F.coalesce("__reach", F.lit(2 * span)), F.lit(span * 2.0 ** -50))
    reached = reached.withColumn("__level", F.ceil(F.log2(reach)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("__level"))
    key = [*by, "__level", "__cube"]
    probe = _spread_cubes(reached, xyz, side, _AROUND).select(*key, "__q", "__reach", *[F.col(c).alias(f"__q_{c}") for c in xyz])
    # a point stands in the grids of the levels that the queries of its group use
    used = reached.groupBy(*by).agg(F.collect_set("__level").alias("__levels"))
    leveled = attach(pts, used, by, "inner").select("*", F.explode("__levels").alias("__level"))
    leveled = leveled.withColumn("__cube", _cube(xyz, side)).select(*key, p_id, *p_cols)
    return probe.join(leveled, key, "inner")


def knn_join(
    queries: DataFrame, points: DataFrame, k: int, by=(), *, q_id: str, p_id: str,
    xyz=XYZ, exclude_same_id=False, p_cols=(),
) -> DataFrame:
    """Exact k nearest points of each query inside its group.

    Points and queries lie along a Z-curve.  The neighbours on the curve bound the k-th distance; the bound picks the grid
    whose cubes are as large, and one equi-join on (group, level, cube) with the 27 cubes around finds all that is nearer.  Depth follows
    the local density: a far outlier, a crowd or a huge group costs no other query anything.  Of points with
    equal coordinates only the first ``k`` (+1 when the query itself may be among them) by id can ever be
    chosen, so the others leave before the join.
    """
    by = list(by)
    p_cols = [c for c in dict.fromkeys([*p_cols, *xyz]) if c != p_id]
    found = knn_candidates(queries, points, k, by, q_id=q_id, p_id=p_id, xyz=xyz, exclude_same_id=exclude_same_id, p_cols=p_cols)
    d2 = v.dist2(tuple(F.col(f"__q_{c}") for c in xyz), tuple(F.col(c) for c in xyz))
    found = found.withColumn("distance", F.sqrt(d2)).where(
        F.col("__reach").isNull() | (F.col("distance") <= F.col("__reach"))
    )
    if exclude_same_id:
        found = found.where(F.col("__q") != F.col(p_id))
    w = Window.partitionBy(*by, "__q").orderBy("distance", p_id)
    return (
        found.withColumn("neighbor_rank", F.row_number().over(w))
        .where(F.col("neighbor_rank") <= k)
        .select(
            *by, F.col("__q").alias(f"a_{q_id}"), F.col(p_id).alias(f"b_{p_id}"),
            *[F.col(c).alias(f"b_{c}") for c in p_cols], "distance", "neighbor_rank",
        )
    )


def knn_tiered(residues: DataFrame, k: int, by=(), *, id_col: str = "pos", xyz=XYZ) -> DataFrame:
    """k nearest residues (self included) with a preference order.

    First those with coordinates by distance, then residues without coordinates by
    separation along the sequence: adjusted distance 1e8 + 1e6 * |separation|.  A residue
    without coordinates sees everything by separation.  ``id_col`` is the position.
    """
    by = list(by)
    if not by:
        residues = residues.withColumn("__all", F.lit(0))
        return knn_tiered(residues, k, ["__all"], id_col=id_col, xyz=xyz).drop("__all")
    has = F.col(xyz[0]).isNotNull() & F.col(xyz[1]).isNotNull() & F.col(xyz[2]).isNotNull()
    tagged = residues.select(*by, id_col, *xyz, has.alias("__has"))
    with_xyz = tagged.where("__has").drop("__has")
    real = knn_join(with_xyz, with_xyz, k, by, q_id=id_col, p_id=id_col).select(
        *by, F.col(f"a_{id_col}").alias("i"), F.col(f"b_{id_col}").alias("j"),
        F.sqrt(F.col("distance") * F.col("distance") + F.lit(1e-8)).alias("adjusted"),
    )
    # by separation: k - 1 residues to each side, in the order of positions (which may have
    # gaps), are enough for a residue without coordinates
    numbered = over_groups(tagged.select(*by, F.col(id_col).alias("j"), "__has"), by, ["j"], __no=("row_number",))
    offsets = F.explode(F.sequence(F.lit(-(k - 1)), F.lit(k - 1)))
    lost = (
        numbered.where(~F.col("__has")).select(*by, F.col("j").alias("i"), "__no")
        .withColumn("__o", offsets).withColumn("__no", (F.col("__no") + F.col("__o")).cast("long")).drop("__o")
    )
    lost = lost.join(numbered.select(*by, "__no", "j"), [*by, "__no"], "inner")
    # a residue with coordinates needs missing ones only in a group with fewer than k real
    sizes = tagged.groupBy(*by).agg(F.count_if("__has").alias("__real"))
    short = sizes.where(F.col("__real") < k)
    seekers = attach(with_xyz, short, by, "inner")
    absent = attach(tagged.where(~F.col("__has")), short, by, "inner")
    # fewer than k seekers per group; number the absent ones and look k to each side
    absent = over_groups(absent.select(*by, F.col(id_col).alias("j")), by, ["j"], __at=("row_number",))
    marks = over_groups(
        absent.select(*by, F.col("j").alias("__pos"), "__at", F.lit(0).alias("__s")).unionByName(
            seekers.select(*by, F.col(id_col).alias("__pos"), F.lit(None).cast("long").alias("__at"), F.lit(1).alias("__s"))
        ),
        by, ["__pos", "__s"], __left=("ffill", "__at"),
    ).where("__s = 1")
    marks = marks.select(
        *by, F.col("__pos").alias("i"),
        F.explode(F.sequence(F.lit(1 - k), F.lit(k))).alias("__o"), F.coalesce("__left", F.lit(0)).alias("__l"),
    ).withColumn("__at", F.col("__l") + F.col("__o")).select(*by, "i", "__at")
    filler = marks.join(absent, [*by, "__at"], "inner").select(*by, "i", "j")
    separated = lost.select(*by, "i", "j").unionByName(filler).withColumn(
        "adjusted", F.lit(1e8) + F.abs(F.col("i") - F.col("j")) * F.lit(1e6)
    )
    w = Window.partitionBy(*by, "i").orderBy("adjusted", "j")
    return (
        real.unionByName(separated)
        .withColumn("neighbor_rank", F.row_number().over(w))
        .where(F.col("neighbor_rank") <= k)
        .withColumn("has_coordinates", F.col("adjusted") < 5e7)
        .withColumn("is_residue", F.col("adjusted") < 5e9)
    )


def representative_points(atoms: DataFrame, by=("structure_id", "chain", "resid", "insertion"), *, atom="atom_name", order="line_idx") -> DataFrame:
    """(by, first_line, x, y, z) per residue: its CB, or its CA without one; residues with neither have no row."""
    names = F.col(atom).isin("CB", "CA")
    place = F.struct(*[F.col(c) for c in XYZ])
    best = atoms.where(names).groupBy(*by).agg(F.min(order).alias("first_line"), F.min_by(place, F.struct(F.col(atom) != "CB", F.col(order))).alias("__p"))
    return best.select(*by, "first_line", "__p.*")


def nearest_chain(residues: DataFrame, points: DataFrame, by=(), *, chain="chain", id_col="idx", point_id="point_id", xyz=XYZ) -> DataFrame:
    """Chain of the residue position (CB, or CA without CB) nearest to each point."""
    near = knn_join(points, residues, 1, by, q_id=point_id, p_id=id_col, p_cols=[chain], xyz=xyz)
    return near.select(*by, F.col(f"a_{point_id}").alias(point_id), F.col(f"b_{chain}").alias(chain), "distance")


# ------------------------------------------------------------------- pockets
def near_any(
    points: DataFrame, targets: DataFrame, radius, by=(), *, id_col: str, xyz=XYZ, target_xyz=None
) -> DataFrame:
    """Distinct ids of ``points`` with at least one target closer than ``radius``."""
    target = targets.select(*by, *[F.col(t).alias(c) for t, c in zip(target_xyz or xyz, xyz)])
    pairs = radius_join(points, target, radius, by, a_cols=[id_col], xyz=xyz)
    return pairs.select(*by, F.col(f"a_{id_col}").alias(id_col)).distinct()


def pocket_atoms(atoms: DataFrame, ligand: DataFrame, radius, by=(), *, id_col="idx", xyz=XYZ, around="atoms") -> DataFrame:
    """Atoms within ``radius`` of any ligand atom, or of the ligand's centroid."""
    by = list(by)
    if around == "centroid":
        centre = ligand.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in xyz])
        joined = attach(atoms, centre, by, "inner")
        d = v.dist(tuple(F.col(c) for c in xyz), tuple(F.col(f"__m_{c}") for c in xyz))
        return joined.where(d < F.lit(float(radius))).select(*atoms.columns)
    ids = near_any(atoms, ligand, radius, by, id_col=id_col, xyz=xyz)
    return atoms.join(ids, [*by, id_col], "left_semi")


def extract_pockets(atoms: DataFrame, residues: DataFrame, pockets: DataFrame, radius=20.0, top_n=1, *, by=("structure_id",), chain="A") -> DataFrame:
    """Atoms of one chain that belong to residues near each of the first pocket centres.

    ``residues`` has one representative point (CB, CA for glycine) per residue with
    columns ``by``, chain, resid, x, y, z and, if it has one, insertion; ``pockets`` has ``by``,
    pocket_rank (1-based row order), center_x, center_y, center_z.  Only ATOM records count
    where ``atoms`` has a record column.
    """
    by = list(by)
    centres = pockets.where(F.col("pocket_rank") <= top_n).select(
        *by, "pocket_rank", *[F.col(f"center_{c}").alias(c) for c in XYZ]
    )
    keys = ["resid", *(["insertion"] if "insertion" in residues.columns and "insertion" in atoms.columns else [])]
    mine = residues.where(F.col("chain") == chain)
    hits = radius_join(mine, centres, radius, by, a_cols=keys, b_cols=["pocket_rank"])
    hits = hits.select(*by, *[F.col(f"a_{c}").alias(c) for c in keys], F.col("b_pocket_rank").alias("pocket_rank")).distinct()
    own = atoms.where(F.col("chain") == chain)
    if "record" in atoms.columns:
        own = own.where(F.col("record") == "ATOM")
    return own.join(hits, [*by, *keys], "inner")
