"""Connected components of a link table by alternating large-star and small-star steps.

Every round moves links to smaller ids and ends as a written table, so lineage stays short and
a lost executor repeats one round at most.  A step is a grouped minimum (combined before the
shuffle) joined back to the links; neighbours of a node are never brought together, so a node
with very many links is only a hot join key that adaptive execution can split.  The number of
rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscreen.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """(a > b) links -> for every node u, its larger neighbours v linked to u's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    larger = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a > b: v is the larger end
    return larger.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """(a > b) links -> for every node a, its smaller neighbours and itself linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every end of a link: the least id reachable.

    Links may repeat, point either way or to themselves; nulls link nothing.  Ids of no link do
    not occur in the result.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = known.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = written(ends.distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        links = now.where("a > b")
        now = written(_small_star(_large_star(links)).distinct().unionAll(now.where("a = b")))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        now.where("a > b").select(F.col("b").alias("id"), F.col("b").alias("component"))
    ).groupBy("id").agg(F.min("component").alias("component"))


def spanning_pairs(rows: int, points: int, neighbours: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) index pairs that span the links of one block of points.

    ``neighbours(i)`` gives the points linked to row ``i``.  At most one pair per point comes
    back, however many links there are.
    """
    parent = np.arange(points)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for i in range(rows):
        near = neighbours(i)
        if len(near):
            roots = {root(i), *(root(k) for k in np.unique(parent[near]).tolist())}
            top = min(roots)
            for r in roots:
                parent[r] = top
            parent[near] = top
    roots = np.array([root(i) for i in range(points)], dtype=np.int64)
    moved = np.flatnonzero(roots != np.arange(points))
    return moved, roots[moved]


def sorted_groups(batches, keys: list[str]):
    """Groups of an Arrow stream sorted by ``keys``: dictionaries of arrays, one group in memory at a time."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            new |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            this = tuple(columns[k][lo] for k in keys)
            if held and this != key:
                yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
            key = this
            held.append({n: c[lo:hi] for n, c in columns.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
