"""Nearest neighbours by inner product from a forest of random-projection trees.

1. Vectors are scaled to the longest and given one more component that makes all of them unit vectors; queries
   get a zero there.  Nearness in this space is the order of inner products.
2. ``TREES`` trees are fitted on a sample of at most ``SAMPLE`` vectors: a node projects on the random direction, of
   ``DIRECTIONS``, along which its vectors spread most, and cuts at the median, until ``LEAF`` sample vectors are left.  The forest holds
   at most ``TREES * 2 * SAMPLE / LEAF`` directions; this bounds what is sent to the tasks.
3. Every vector goes down every tree: one index row per tree, by leaf.
4. A query goes down all trees with one priority queue of branches not taken, nearest cut first, whatever tree
   they belong to.  In the first round it visits leaves until they hold ``FIRST`` rows; the inner products found
   there bound its distance d to the last neighbour.  In the second it goes on until the nearest branch left
   is ``REACH * d / sqrt(D)`` away: a random direction sees a distance d as d / sqrt(D).  The more
   alike the distances are, the more leaves that takes; no count of candidates cuts it off.
5. Leaves meet their queries in blocks of at most ``TILE`` vectors and ``CHUNK`` visits; a leaf or a crowd of any
   size is many blocks.  A block reranks exactly, in double precision, and returns what may still be among the first k.

Equal vectors are folded before: only the k + 1 smallest ids of a vector can be among the first k of anything.

Defined cases: null and zero vectors and vectors with null or non-finite components take no part, nor does a null
id; vectors of different length never meet; equal rows are one; several vectors under one id are each searched, and the best score of
a pair of ids counts; a query is no neighbour of itself; an empty table has no result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structscreen.llm.common import written

SAMPLE, LEAF, TREES, DIRECTIONS = 65_536, 256, 8, 16
FIRST, REACH = 2_000, 0.65
TILE, CHUNK = 4_096, 100_000


class Forest:
    """Trees over unit vectors of one length: node ``i`` projects on ``planes[i]`` and cuts at ``cuts[i]``.

    ``below[i]`` are the nodes of the lower and the upper side; a leaf ``k`` is written ``~k``.
    """

    def __init__(self, unit: np.ndarray, first_leaf: int, seed: int = 42):
        rng = np.random.default_rng([seed, unit.shape[1]])
        planes, self.below, self.roots, self.leaves = [], [], [], 0
        cuts: list[float] = []

        def grow(rows: np.ndarray) -> int:
            if len(rows) > LEAF:
                tried = rng.normal(size=(DIRECTIONS, unit.shape[1]))
                tried /= np.linalg.norm(tried, axis=1, keepdims=True)
                plane = tried[np.argmax((unit[rows[:: max(1, len(rows) // 256)]] @ tried.T).std(axis=0))]
                at = unit[rows] @ plane
                cut = float(np.median(at))
                above = at > cut
                if above.any() and not above.all():
                    node = len(planes)
                    planes.append(plane)
                    cuts.append(cut)
                    self.below.append(None)
                    self.below[node] = (grow(rows[~above]), grow(rows[above]))
                    return node
            self.leaves += 1
            return ~(first_leaf + self.leaves - 1)

        for _ in range(TREES):
            self.roots.append(grow(rng.permutation(len(unit))))
        self.planes, self.cuts = np.array(planes).reshape(-1, unit.shape[1]), np.array(cuts)

    def route(self, unit: np.ndarray) -> np.ndarray:
        """(rows, TREES) leaves."""
        out = np.empty((len(unit), len(self.roots)), dtype=np.int64)

        def down(node: int, rows: np.ndarray, tree: int) -> None:
            if node < 0:
                out[rows, tree] = ~node
            elif len(rows):
                above = unit[rows] @ self.planes[node] > self.cuts[node]
                down(self.below[node][0], rows[~above], tree)
                down(self.below[node][1], rows[above], tree)

        for tree, root in enumerate(self.roots):
            down(root, np.arange(len(unit)), tree)
        return out

    def visits(self, margins: list[float], sizes: dict[int, int], reach: float | None) -> list[int]:
        """Leaves of one query by one priority queue over all trees.

        ``reach`` None: the first ones, until they hold ``FIRST`` rows.  Else those after them whose branch is at most ``reach`` away.
        """
        queue = [(0.0, root) for root in self.roots]
        found, rows = [], 0
        while queue:
            away, node = heapq.heappop(queue)
            early = rows < FIRST
            if not early and (reach is None or away > reach):
                break
            while node >= 0:
                margin = margins[node]
                low, high = self.below[node]
                near, far = (high, low) if margin > 0 else (low, high)
                heapq.heappush(queue, (max(away, abs(margin)), far))
                node = near
            if early == (reach is None):
                found.append(~node)
            rows += sizes.get(~node, 0)
        return found


class Space:
    """Scale, longest vector and forests by vector length; a length that the sample lacks is one leaf, ``-length``."""

    def __init__(self, scale: float, longest: float, sample: list[np.ndarray]):
        self.scale, self.longest, self.forests, leaves = scale, longest, {}, 0
        by_length: dict[int, list[np.ndarray]] = {}
        for x in sample:
            by_length.setdefault(len(x), []).append(x)
        for length, rows in sorted(by_length.items()):
            self.forests[length] = Forest(self.unit(np.stack(rows)), leaves)
            leaves += self.forests[length].leaves

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def toward(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def reach(self, x: np.ndarray, last: float) -> float:
        """How far branches are followed if the last neighbour so far has the inner product ``last``."""
        cosine = last / self.scale / self.longest / float(np.linalg.norm(x))
        return REACH * math.sqrt(max(0.0, 2 - 2 * cosine)) / math.sqrt(len(x) + 1)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each length in a list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


_ENTRY = "leaf long, key long, vec {0}, ids array<long>"
_VISIT = "leaf long, key long, vec {0}, last double"


def _index(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """(key, vec, ids) -> one row per tree."""
    for batch in batches:
        for rows, x in _by_length(batch.column("vec")):
            forest = space.forests.get(x.shape[1])
            leaves = forest.route(space.unit(x)) if forest else np.full((len(x), 1), -x.shape[1])
            take = pa.array(np.repeat(rows, leaves.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), *(batch.column(c).take(take) for c in ("key", "vec", "ids"))], ["leaf", "key", "vec", "ids"])


def _visit(batches: Iterator[pa.RecordBatch], space: Space, sizes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(key, vec[, last]) -> (leaf, key, vec, last): the leaves of the first round, or with ``last`` those of the second."""
    for batch in batches:
        later = "last" in batch.schema.names
        for rows, x in _by_length(batch.column("vec")):
            forest = space.forests.get(x.shape[1])
            for start in range(0, len(rows), 512):
                some, at = x[start:start + 512], rows[start:start + 512]
                if forest:
                    margins = (space.toward(some) @ forest.planes.T - forest.cuts).tolist()
                    last = batch.column("last").take(pa.array(at)).to_pylist() if later else []
                    reach = [(math.inf if b is None else space.reach(v, b)) for v, b in zip(some, last)] if later else [None] * len(some)
                    found = [forest.visits(m, sizes, r) for m, r in zip(margins, reach)]
                else:
                    found = [[] if later else [-x.shape[1]] for _ in at]
                take = pa.array(np.repeat(at, [len(f) for f in found]), pa.int64())
                lasts = batch.column("last").take(take) if later else pa.nulls(len(take), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([k for f in found for k in f], pa.int64()), batch.column("key").take(take), batch.column("vec").take(take), lasts], ["leaf", "key", "vec", "last"])


def _best(query: np.ndarray, last: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score): per query the k best ids of a block, of those at least ``last``; ties to smaller ids."""
    close = query @ x.T
    size = np.array([len(i) for i in ids])
    least = last
    if close.shape[1] > k:
        least = np.maximum(last, np.partition(close, close.shape[1] - k, axis=1)[:, close.shape[1] - k])
    slack = 1e-9 * np.linalg.norm(query, axis=1) * np.linalg.norm(x, axis=1).max()
    row, column = np.nonzero(close >= (least - slack)[:, None])
    score = (query[row] * x[column]).sum(axis=1)  # one order of summation wherever a pair meets
    row, score, column = (v[score >= last[row]] for v in (row, score, column))
    times = size[column]
    row, score = np.repeat(row, times), np.repeat(score, times)
    found = np.concatenate([ids[c] for c in column]) if len(column) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((-score, found, row))
    row, score, found = row[order], score[order], found[order]
    if len(row):
        fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (found[1:] != found[:-1])))
        row, score, found = row[fresh], score[fresh], found[fresh]
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        nth = np.arange(len(row)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(row)]))))
        row, score, found = row[nth < k], score[nth < k], found[nth < k]
    return row, found, score


def _rerank(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leaf, tile, chunk, visit): the vectors of a block, then its queries -> (key, id, score)."""
    block, parts = None, []
    held_x, held_ids = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = ("leaf", "tile", "chunk", "visit")
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if tuple(marks[lo, :3]) != block:
                block, parts, held_x, held_ids = tuple(marks[lo, :3]), [], None, []
            part = batch.slice(lo, hi - lo)
            if not marks[lo, 3]:
                parts.append(part)
                continue
            if not parts and held_x is None:
                continue  # no vector in this leaf
            if held_x is None:
                held_x = np.concatenate([x for p in parts for _, x in _by_length(p.column("vec"))])
                held_ids = [np.array(i) for p in parts for i in p.column("ids").to_pylist()]
                parts = []
            for rows, query in _by_length(part.column("vec")):
                for start in range(0, len(rows), 256):
                    at = rows[start:start + 256]
                    last = part.column("last").take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.float64)
                    row, found, score = _best(query[start:start + 256], np.where(np.isnan(last), -np.inf, last), held_x, held_ids, k)
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(at[row])), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["key", "id", "score"])


def _blocks(index: DataFrame, visits: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """Every visit meets the vectors of its leaf; ``index`` and ``visits`` are written tables."""
    spark = index.sparkSession
    crowds = {r["leaf"]: r["n"] for r in visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per leaf
    shape = spark.createDataFrame([(leaf, -(-sizes[leaf] // TILE), -(-n // CHUNK)) for leaf, n in crowds.items() if leaf in sizes], "at long, tiles int, chunks int")
    dealt = F.broadcast(shape)  # one row per leaf of the forest
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = index.join(dealt, F.col("leaf") == F.col("at")).select("leaf", part("tiles").alias("tile"), every("chunks").alias("chunk"), F.lit(0).alias("visit"), "key", "vec", "ids", F.lit(None).cast("double").alias("last"))
    asked = visits.join(dealt, F.col("leaf") == F.col("at")).select("leaf", every("tiles").alias("tile"), part("chunks").alias("chunk"), F.lit(1).alias("visit"), "key", "vec", F.lit(None).cast("array<long>").alias("ids"), "last")
    met = vectors.unionAll(asked).repartition("leaf", "tile", "chunk").sortWithinPartitions("leaf", "tile", "chunk", "visit")
    return met.mapInArrow(lambda b: _rerank(b, k), "key long, id long, score double")


def _first(found: DataFrame, by: str, k: int) -> DataFrame:
    """The k best ids per ``by``, numbered from 1 as ``rank``."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("id"))
    return found.groupBy(by, "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): per row of ``df`` where ``queries`` holds, the k rows found with the largest inner product."""
    spark = df.sparkSession
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    usable = "id IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vec, x -> x <> 0)"
    rows = rows.where(usable)
    smallest = rows.groupBy("vec", "id").agg(F.max("asks").alias("asks")).withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("nth") <= k + 1)
    ids = smallest.groupBy("vec").agg(F.collect_list("id").alias("ids"))
    folded = written(ids.select(F.monotonically_increasing_id().alias("key"), "vec", "ids"))
    asking = rows.where("asks").select(F.col("id").alias("query_id"), F.col("vec").alias("v")).distinct()
    asking = written(asking.join(folded, F.col("v") == F.col("vec")).select("query_id", "key"))
    peaks = folded.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("scale")).first()
    scale = peaks["scale"] or 1.0
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x.cast("double") / F.lit(scale)) * (x.cast("double") / F.lit(scale))))
    longest = folded.agg(F.max(length)).first()[0] or 1.0
    every = F.lit(max(1, -(-peaks["n"] // SAMPLE)))
    sample = folded.where(F.pmod(F.xxhash64("key"), every) == 0).orderBy(F.xxhash64("key")).limit(SAMPLE).select("vec").toArrow()
    space = Space(scale, longest, [x for chunk in sample.column("vec").chunks for _, found in _by_length(chunk) for x in found])
    index = written(folded.mapInArrow(lambda b: _index(b, space), _ENTRY.format(kind)))
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per leaf
    questions = folded.join(asking.select("key").distinct(), "key", "left_semi").select("key", "vec")
    early = written(questions.mapInArrow(lambda b: _visit(b, space, sizes), _VISIT.format(kind)))
    best = written(_first(_blocks(index, early, sizes, k + 1), "key", k + 1))
    last = best.where(F.col("rank") == k + 1).select("key", F.col("score").alias("last"))
    late = written(questions.join(last, "key", "left").mapInArrow(lambda b: _visit(b, space, sizes), _VISIT.format(kind)))
    found = best.select("key", "id", "score").unionAll(_blocks(index, late, sizes, k + 1))
    merged = _first(found, "key", k + 1).select("key", "id", "score")
    pairs = asking.join(merged, "key").where("query_id <> id")
    return _first(pairs, "query_id", k).select("query_id", "rank", "id", "score")
