"""SimHash near-duplicates by a segment-popcount embedding.

A text's fingerprint takes, per bit, the majority over the XXH64 hashes of its 3-word shingles.
Fingerprints are cut into 32 segments of two bits; the segment popcounts are a point with 32
small integer coordinates.  One differing bit moves one coordinate by one at most, so the
Manhattan distance of two points never exceeds the Hamming distance of the fingerprints: it is
a lower bound that may only admit too much.

The range join under that bound goes over a grid: the coordinates form six blocks; points at
distance 3 or less differ in three blocks at most, so they agree in at least three.  For each of
the 20 choices of three blocks a point lies in one cell (the coordinates of those blocks); two
points in range share a cell for some choice.  Candidates of a cell are verified exactly with
XOR and popcount.  Only different fingerprints take part, copies are folded in first.

A cell of any size is cut into tiles; a task verifies one pair of tiles and returns a spanning
forest of the links found there, never all pairs.  Cells of a single point are dropped before.

Defined cases: null, empty or blank texts have fingerprint zero and link like any other; fewer
than three words are one shingle; a null id never names a component, and a class of null ids
only has component null; rows with equal ids and texts get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from structscreen.llm.common import written
from structscreen.llm.components import components, sorted_groups, spanning_pairs

SHINGLE = 3
SEED = 42
MAX_BITS = 3
TILE = 1024
_BLOCKS = (0, 6, 12, 17, 22, 27, 32)  # first segment of each block
_CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMNS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(words) - SHINGLE + 1, xxhash.xxh64_intdigest
    counts = np.zeros(2048, dtype=np.int64)
    first, last = starts[:n].tolist(), ends[SHINGLE - 1:].tolist()
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + _CHUNK], last[at:at + _CHUNK])], dtype="<u8")
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLUMNS).ravel(), minlength=2048)
    ones = np.concatenate([counts[256 * k:256 * (k + 1)] @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).astype(np.int64))


def add_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint as a signed long (same 64 bits)."""
    return df.withColumn(out, _fingerprints(F.col(text_col).cast("string")))


def _cells():
    """(embedding, masks): the point packed two bits per coordinate, one mask per choice of blocks."""
    odd = F.lit(0x5555555555555555)
    upper, lower = F.shiftrightunsigned("fp", 1).bitwiseAND(odd), F.col("fp").bitwiseAND(odd)
    both, either = upper.bitwiseAND(lower), upper.bitwiseXOR(lower)
    point = F.shiftleft(both, 1).bitwiseOR(either)  # popcount 0, 1 or 2 of every segment
    masks = []
    for chosen in combinations(range(6), 3):
        mask = sum(3 << (2 * s) for k in chosen for s in range(_BLOCKS[k], _BLOCKS[k + 1]))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return point, masks


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (choice, cell, i, j): one group is a tile or a pair of tiles of a cell."""
    for group in sorted_groups(batches, ["t", "cell", "i", "j"]):
        fps, one = group["fp"].view(np.uint64), group["i"][0] == group["j"][0]
        rows = fps if one else fps[group["tile"] == group["i"]]
        points = fps if one else np.concatenate([rows, fps[group["tile"] != group["i"]]])
        after = (lambda i: i + 1) if one else (lambda i: len(rows))  # noqa: B023
        a, b = spanning_pairs(len(rows), len(points), lambda i: np.flatnonzero(np.bitwise_count(points[after(i):] ^ rows[i]) <= MAX_BITS) + after(i))  # noqa: B023
        points = points.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(points[a]), pa.array(points[b])], ["a", "b"])


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Links (a, b) that span every class of fingerprints (column ``fp``, all different) within ``MAX_BITS`` bits."""
    point, masks = _cells()
    choices = F.array(*[F.struct(F.lit(k).alias("t"), F.col("_p").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])
    rows = fps.select("fp", point.alias("_p")).select("fp", F.inline(choices))
    shared = rows.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    crowded = rows.join(shared, ["t", "cell"]).select("t", "cell", "fp", tiles.alias("k"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile"))
    dealt = crowded.select("t", "cell", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")).select(
        "t", "cell", "fp", "tile", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j")
    )
    return dealt.repartition("t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j").mapInArrow(_verify, "a long, b long")


def _classes(kinds: DataFrame) -> DataFrame:
    """``(k, class, least)``: the class of each fingerprint of ``kinds`` (fp, least)."""
    found = components(link_fingerprints(kinds.select("fp")))
    return kinds.join(found, kinds["fp"] == found["id"], "left").select(F.col("fp").alias("k"), F.coalesce("component", "fp").alias("class"), "least")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` per row: 16 hex digits, least id reachable by links."""
    fps = written(add_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "fp"))
    kinds = fps.groupBy("fp").agg(F.min("id").alias("least"))
    members = _classes(kinds)
    named = members.groupBy("class").agg(F.min("least").alias("component_id")).withColumnRenamed("class", "c")
    by_fp = members.join(named, F.col("class") == F.col("c")).select("k", "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("k"), "left").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` per class of near duplicates: of the least id (null ids last), then of the least hash of the whole row.

    Null and repeated ids are judged by their texts like any other; of equal rows one stays.
    """
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    fps = written(add_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.alias("row")), "text").select("id", "row", "fp"))
    rows = fps.groupBy("fp", "id", "row").agg(F.count(F.lit(1)).alias("n"))
    kinds = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row", "n")).alias("least"))
    best = _classes(kinds).groupBy("class").agg(F.min("least").alias("b")).select(F.col("b.id").alias("_id"), F.col("b.row").alias("_r"), F.col("b.n").alias("_n"))
    best = written(best)

    def kept(keys: DataFrame) -> DataFrame:
        return df.withColumn("_row", row).join(keys, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_r")), "left_semi")

    once = kept(best.where("_n = 1"))
    several = best.where("_n > 1")
    if not several.isEmpty():
        once = once.unionByName(kept(several).dropDuplicates([id_col, "_row"]))
    return once.drop("_row")
