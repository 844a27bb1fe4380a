"""Alignments: matched columns, trusted windows, gap bookkeeping, gap filling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structscreen.functions import vec as v
from structscreen.plans.skew import over_groups

XYZ = ("x", "y", "z")


def chars(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(c, ""), lambda s: s != "")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def text_of(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def lists(values: pa.Array, sizes: list[int | None]) -> pa.Array:
    """A list column from its entries and the length of each row, null for a null row."""
    ends = np.cumsum([n or 0 for n in sizes], dtype=np.int32)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([n is None for n in sizes] + [False]))
    return pa.ListArray.from_arrays(offsets, values)


_MAX_CELLS = 2_000_000


def _characters(texts: list[str], total: int) -> tuple[pa.Array, np.ndarray]:
    """All characters of all texts as one string column, and where they are no gap."""
    joined = "".join(texts)
    data = joined.encode()
    if len(data) == total:  # one byte per character: the text itself is the column's buffer
        raw = np.frombuffer(data, dtype=np.uint8)
        offsets = np.arange(total + 1, dtype=np.int32)
        return pa.StringArray.from_buffers(total, pa.py_buffer(offsets), pa.py_buffer(data)), raw != 45
    letters = list(joined)
    return pa.array(letters, pa.string()), np.array(letters) != "-"


def _residue_numbers(there: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    upto = np.cumsum(there, dtype=np.int64)
    before = np.where(starts > 0, upto[np.maximum(starts - 1, 0)], 0)
    return pa.array(upto - np.repeat(before, sizes) - 1, mask=~there)


def _columns_of(batch: pa.RecordBatch, ref: list[str], mod: list[str], rows: range, n_keys: int) -> pa.RecordBatch:
    sizes = np.array([len(ref[i]) for i in rows], dtype=np.int64)
    total = int(sizes.sum())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    r, r_there = _characters([ref[i] for i in rows], total)
    m, m_there = _characters([mod[i] for i in rows], total)
    which = pa.array(np.repeat(np.arange(rows.start, rows.stop), sizes))
    keys = [batch.column(c).take(which) for c in range(n_keys)]
    col = pa.array(np.arange(total, dtype=np.int64) - np.repeat(starts, sizes))
    arrays = [*keys, col, r, m, _residue_numbers(r_there, starts, sizes), _residue_numbers(m_there, starts, sizes)]
    names = [*batch.schema.names[:n_keys], "col", "ref_char", "mod_char", "ref_idx", "mod_idx"]
    return pa.RecordBatch.from_arrays(arrays, names)


def explode_alignment(df: DataFrame, by=("id",), ref="ref_aln", mod="mod_aln") -> DataFrame:
    """(by, col, ref_char, mod_char, ref_idx, mod_idx); an index is null at a gap.

    Strings of different length are an error.  An alignment is one row, so its residue
    numbers are counted inside the row, on whole Arrow batches, and nothing is shuffled
    however long it is.  Output batches stay near two million columns.
    """
    by = list(by)
    keys = df.select(*by).schema.fields
    schema = T.StructType([
        *keys, T.StructField("col", T.LongType()), T.StructField("ref_char", T.StringType()), T.StructField("mod_char", T.StringType()),
        T.StructField("ref_idx", T.LongType()), T.StructField("mod_idx", T.LongType()),
    ])
    n_keys = len(keys)

    def run(batches):
        for batch in batches:
            texts = [[t or "" for t in batch.column(n_keys + i).to_pylist()] for i in (0, 1)]
            first = cells = 0
            for i, (r, m) in enumerate(zip(*texts)):
                if len(r) != len(m):
                    raise ValueError("aligned strings differ in length")
                if cells and cells + len(r) > _MAX_CELLS:
                    yield _columns_of(batch, *texts, range(first, i), n_keys)
                    first, cells = i, 0
                cells += len(r)
            if cells:
                yield _columns_of(batch, *texts, range(first, len(texts[0])), n_keys)

    return df.select(*by, ref, mod).mapInArrow(run, schema)


def matched_pairs(columns: DataFrame, equal_only=False) -> DataFrame:
    """Columns where both sides have a residue, or the same residue."""
    both = columns.where("ref_idx IS NOT NULL AND mod_idx IS NOT NULL")
    return both.where("ref_char = mod_char") if equal_only else both


def identity_ratio(df: DataFrame, ref="ref_aln", mod="mod_aln", denominator="window", start=None, end=None) -> Column:
    """Equal columns over the aligned window, or equal residues over the shorter sequence.

    A row-local expression: nothing is exploded or shuffled.
    """
    r, m = F.col(ref), F.col(mod)
    if start is not None:
        width = F.col(end) - F.col(start)
        r, m = F.substr(r, F.col(start) + 1, width), F.substr(m, F.col(start) + 1, width)
    pairs = F.arrays_zip(chars(r).alias("r"), chars(m).alias("m"))
    if denominator == "window":
        same = F.size(F.filter(pairs, lambda p: p["r"] == p["m"]))
        return F.try_divide(same.cast("double"), F.length(r))
    same = F.size(F.filter(pairs, lambda p: (p["r"] == p["m"]) & (p["r"] != "-")))
    residues = [F.length(F.replace(s, F.lit("-"), F.lit(""))) for s in (r, m)]
    return F.try_divide(same.cast("double"), F.least(*residues))


def recovery(native: str, sampled: str) -> Column:
    """Share of positions where a designed sequence equals the native one."""
    pairs = F.arrays_zip(chars(native).alias("n"), chars(sampled).alias("s"))
    return F.try_divide(F.size(F.filter(pairs, lambda p: p["n"] == p["s"])).cast("double"), F.length(native))


def drop_short_runs(df: DataFrame, by=("id",), idx="idx") -> DataFrame:
    """Drop short continuous runs of an index, with the exact rule of the aligner clean-up.

    At a break the run that just closed goes if its count is at most 3, where the first
    run counts one less than its length.  The last run always stays.
    """
    by = list(by)
    numbered = over_groups(df, by, [idx], __n=("row_number",), __next=("lead", idx))
    numbered = numbered.withColumn("__run", F.col(idx) - F.col("__n"))
    runs = numbered.groupBy(*by, "__run").agg(
        F.count(F.lit(1)).alias("__len"), F.min("__n").alias("__first"),
        F.max(F.col("__next").isNull().cast("int")).alias("__last"),
    )
    count = F.when(F.col("__first") == 1, F.col("__len") - 1).otherwise(F.col("__len"))
    keep = runs.where((F.col("__last") == 1) | (count > 3)).select(*by, "__run")
    return numbered.join(keep, [*by, "__run"], "left_semi").drop("__n", "__next", "__run")


def kept_runs(text, dropped: str) -> Column:
    """``drop_short_runs`` for a structure in one row: (start, length) of the runs that stay.

    The index is the place in the text, and the characters of ``dropped`` are its breaks.
    """
    breaks = code_points(dropped)
    fields = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])

    @F.arrow_udf(T.ArrayType(fields))
    def runs(texts: pa.Array) -> pa.Array:
        sizes, starts, lengths = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in texts.to_pylist():
            idx = np.flatnonzero(~np.isin(code_points(t), breaks)) if t else np.zeros(0, np.int64)
            first = np.flatnonzero(np.diff(idx, prepend=-2) != 1)
            length = np.diff(first, append=len(idx))
            keep = length > 3
            if len(length):
                keep[0] = length[0] > 4  # the first run counts one less
                keep[-1] = True
            sizes.append(None if t is None else int(keep.sum()))
            starts.append(idx[first[keep]])
            lengths.append(length[keep])
        both = pa.StructArray.from_arrays([np.concatenate(starts), np.concatenate(lengths)], ["start", "length"])
        return lists(both, sizes)

    return runs(text)


def trusted_window_of(ref, mod, n=10) -> Column:
    """``trusted_window`` for an alignment in one row: struct (start_idx, end_idx), -1 if there is none."""
    @F.arrow_udf(T.StructType([T.StructField("start_idx", T.LongType()), T.StructField("end_idx", T.LongType())]))
    def window(refs: pa.Array, mods: pa.Array) -> pa.Array:
        found = []
        for r, m in zip(refs.to_pylist(), mods.to_pylist()):
            r, m = code_points(r or ""), code_points(m or "")
            if len(r) != len(m):
                raise ValueError("aligned strings differ in length")
            edge = np.diff((r == m).astype(np.int8), prepend=0, append=0)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = end - start >= n
            found.append((start[long][0], end[long][-1]) if long.any() else (-1, -1))
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pairs[:, 0], pairs[:, 1]], ["start_idx", "end_idx"])

    return window(ref, mod)


def trusted_window(columns: DataFrame, by=("id",), n=10) -> DataFrame:
    """Start of the first and end of the last stretch of ``n`` equal columns, -1 if none."""
    by = list(by)
    same = columns.where("ref_char = mod_char").select(*by, "col")
    runs = over_groups(same, by, ["col"], __n=("row_number",)).groupBy(*by, (F.col("col") - F.col("__n")).alias("__run")).agg(
        F.min("col").alias("__s"), (F.max("col") + 1).alias("__e"), F.count(F.lit(1)).alias("__len")
    )
    found = runs.where(F.col("__len") >= n).groupBy(*by).agg(F.min("__s").alias("start_idx"), F.max("__e").alias("end_idx"))
    ids = columns.select(*by).distinct()
    return ids.join(found, by, "left").na.fill(-1, ["start_idx", "end_idx"])


def gap_bounds(text: str) -> dict[str, Column]:
    """First residue, one past the last residue (null without any), leading gap length."""
    c = F.col(text)
    lead = F.length(c) - F.length(F.regexp_replace(c, "^-+", ""))
    some = lead < F.length(c)
    return {
        "first_residue": F.when(some, lead),
        "end_residue": F.when(some, F.length(F.regexp_replace(c, "-+$", ""))),
        "leading_gap": lead,
    }


def drop_ref_gaps(df: DataFrame, ref="ref_aln", mod="mod_aln") -> DataFrame:
    """Remove the columns where the reference has a gap; row-local, on whole Arrow batches."""
    @F.arrow_udf(T.StructType([T.StructField("r", T.StringType()), T.StructField("m", T.StringType())]))
    def without(refs: pa.Array, mods: pa.Array) -> pa.Array:
        out = []
        for r, m in zip(refs.to_pylist(), mods.to_pylist()):
            if r is None or m is None:
                out.append((None, None))
                continue
            r = code_points(r)
            m = code_points(m)[:len(r)]
            there = r != 45
            out.append((text_of(r[there]), text_of(m[there[:len(m)]])))
        return pa.StructArray.from_arrays([pa.array([p[i] for p in out], pa.string()) for i in (0, 1)], ["r", "m"])

    return df.withColumn("__p", without(ref, mod)).withColumns({ref: F.col("__p")["r"], mod: F.col("__p")["m"]}).drop("__p")


def fill_gaps_in(reference, model) -> Column:
    """``fill_gaps`` for one coordinate of a structure in one row: arrays by place, null where the model lacks a residue."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def fill(xs: pa.Array, ms: pa.Array) -> pa.Array:
        sizes, out = [], [pa.array([], pa.float64())]
        for x, m in zip(xs, ms):
            if not (x.is_valid and m.is_valid):
                sizes.append(None)
                continue
            x, m = x.values.to_numpy(zero_copy_only=False), m.values
            there = m.is_valid().to_numpy(zero_copy_only=False)
            m = m.to_numpy(zero_copy_only=False).copy()
            ends, i = np.flatnonzero(there), np.flatnonzero(~there)
            after = np.searchsorted(ends, i)
            inside = (after > 0) & (after < len(ends))
            i, after = i[inside], after[inside]
            head, tail = ends[after - 1], ends[after]
            decay = 1.0 - (i - head) / (tail - head)
            m[i] = x[i] + (m[head] - x[head]) * decay + (m[tail] - x[tail]) * (1 - decay)
            there[i] = True
            sizes.append(len(m))
            out.append(pa.array(m, mask=~there))
        return lists(pa.concat_arrays(out), sizes)

    return fill(reference, model)


def fill_gaps(residues: DataFrame, by=("structure_id",), *, idx="ref_idx") -> DataFrame:
    """Model coordinates with missing residues transplanted from the reference.

    ``residues``: by, idx, x y z (reference), mx my mz (model, null where missing).  A
    missing residue is the reference residue moved by the shifts at both ends of the gap,
    weighted by the place in the gap.  Gaps at the ends have one shift only and stay null.
    """
    by = list(by)
    shift = F.when(F.col("mx").isNotNull(), F.struct(
        F.col(idx).alias("i"), *[(F.col(f"m{c}") - F.col(c)).alias(c) for c in XYZ]
    ))
    run = over_groups(residues.withColumn("__s", shift), by, [idx], __head=("ffill", "__s"), __tail=("bfill", "__s"))
    width = F.col("__tail")["i"] - F.col("__head")["i"] - 1
    decay = F.lit(1.0) - (F.col(idx) - F.col("__head")["i"]) / (width + 1)
    filled = {
        f"m{c}": F.coalesce(F.col(f"m{c}"), F.col(c) + F.col("__head")[c] * decay + F.col("__tail")[c] * (1 - decay)) for c in XYZ
    }
    return run.withColumn("filled", F.col("mx").isNull()).withColumns(filled).drop("__s", "__head", "__tail")
