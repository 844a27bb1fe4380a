"""Table utilities: splits, registries, defaults, column order, lookups, ledgers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structscreen import constants as k
from structscreen.functions.text import literal_map
from structscreen.plans.skew import attach, over_groups


def select_split(df: DataFrame, group: str, min_fraction: float | None = None, *, group_col="group", fraction="fraction_of_this_chain") -> DataFrame:
    out = df.where(F.col(group_col) == group)
    return out if min_fraction is None else out.where(F.col(fraction) > min_fraction)


def dataset_registry(dfs: dict[str, DataFrame], aliases: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """All data sets as one table with ``dataset_name``; aliases copy a key column."""
    parts = []
    for name, df in dfs.items():
        for new, old in ((aliases or {}).get(name) or {}).items():
            df = df.withColumn(new, F.col(old))
        parts.append(df.withColumn("dataset_name", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def decode_run_name(df: DataFrame, col: str) -> DataFrame:
    """header__set -> (header with its suffix, dataset name); unknown sets stay as they are."""
    parts = F.split(col, "__")
    head, tail = parts[0], F.get(parts, F.lit(1))
    dataset = F.try_element_at(literal_map(k.RUN_DATASETS), tail)
    suffix = F.coalesce(F.try_element_at(literal_map(k.RUN_HEADER_SUFFIX), tail), F.lit(""))
    return df.withColumns({"header": F.concat(head, suffix), "dataset_name": F.coalesce(dataset, tail)})


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Add a column only where it is absent: a Column, or a name to copy, or a constant."""
    new = {}
    for name, value in defaults.items():
        if name in df.columns:
            continue
        new[name] = value if isinstance(value, Column) else F.col(value) if value in df.columns else F.lit(value)
    return df.withColumns(new) if new else df


def cols_to_front(df: DataFrame, cols) -> DataFrame:
    cols = list(cols)
    return df.select(*cols, *[c for c in df.columns if c not in cols])


def cols_to_end(df: DataFrame, cols) -> DataFrame:
    cols = list(cols)
    return df.select(*[c for c in df.columns if c not in cols], *cols)


def pending(jobs: DataFrame, done: DataFrame, prereq: DataFrame | None = None, key="name") -> DataFrame:
    """Jobs that are not finished and, if asked, have their prerequisite."""
    out = jobs.join(done.select(key), key, "left_anti")
    return out if prereq is None else out.join(prereq.select(key), key, "left_semi")


def design_flags(df: DataFrame, total_yield="total_yield") -> DataFrame:
    return df.withColumn("soluble", F.col(total_yield) > 0.05)


def high_quality(stats: DataFrame, ptm="ptm", plddt="plddt", limit=0.7) -> DataFrame:
    return stats.where((F.col(ptm) > limit) & (F.col(plddt) > limit))


def lookup(df: DataFrame, dim: DataFrame, key: str, strict=True) -> DataFrame:
    """Columns of ``dim`` by key; with ``strict`` an unknown key fails the job.

    No broadcast hint: Spark broadcasts a dimension that its statistics show to be small.
    """
    joined = attach(df, dim.withColumn("__hit", F.lit(True)), [key])
    if strict:
        missing = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))
        value = F.when(F.col("__hit").isNull(), missing.cast(df.schema[key].dataType)).otherwise(F.col(key))
        joined = joined.withColumn(key, value)
    return joined.drop("__hit").select(*df.columns, *[c for c in dim.columns if c != key])


def purge(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def attach_embeddings(residues: DataFrame, emb: DataFrame, by=("complex_id",), keys=("chain_idx", "pos")) -> tuple[DataFrame, DataFrame]:
    """(residues with their vector, rejected complexes).

    A complex is rejected when the number of residues and of vectors differ.
    """
    by = list(by)
    nr = residues.groupBy(*by).agg(F.count(F.lit(1)).alias("n_residues"))
    ne = emb.groupBy(*by).agg(F.count(F.lit(1)).alias("n_vectors"))
    sizes = attach(nr, ne, by).withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0)))
    good = sizes.where("n_residues = n_vectors").select(*by)
    rejects = sizes.where("n_residues <> n_vectors")
    joined = residues.join(good, by, "left_semi").join(emb, [*by, *keys], "inner")
    return joined, rejects


def per_distinct(df: DataFrame, key: str, fn) -> DataFrame:
    """Run ``fn`` once on the distinct keys and join its columns to all rows."""
    return df.join(fn(df.select(key).distinct()), key, "inner")


def combine_caches(dfs: list[DataFrame], name="name", values="values") -> DataFrame:
    """Arrays of several caches per name, concatenated in cache order.

    A name that one cache lacks, or holds twice, is an error.  One grouped pass with partial
    aggregates; nothing is gathered.
    """
    tagged = reduce(lambda a, b: a.unionByName(b), [
        d.select(name, F.lit(i).alias("__i"), F.col(values).alias("__v")) for i, d in enumerate(dfs)
    ])
    parts = [f"__v{i}" for i in range(len(dfs))]
    merged = tagged.groupBy(name).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__v"))).alias(c) for i, c in enumerate(parts)],
        *[F.count_if(F.col("__i") == i).alias(f"__n{i}") for i in range(len(dfs))],
    )
    failed = F.raise_error(F.concat(F.lit("not once in every cache: "), F.col(name).cast("string")))
    known = reduce(lambda a, b: a & b, [F.col(f"__n{i}") == 1 for i in range(len(dfs))])
    return merged.select(
        F.when(known, F.col(name)).otherwise(failed.cast(dfs[0].schema[name].dataType)).alias(name), F.concat(*parts).alias(values)
    )


def normalize_scores(pair: DataFrame, self_q: DataFrame, self_t: DataFrame, dense=False) -> DataFrame:
    """s_ij / sqrt(q_i t_j).  ``pair`` has query, target, score; the others id and score.

    Only stored pairs are returned: an absent pair has similarity 0.  ``dense`` is for a
    list of pairs that already names every wanted pair, with null for no score.
    """
    q = self_q.select(F.col("query"), F.col("score").alias("__q"))
    t = self_t.select(F.col("target"), F.col("score").alias("__t"))
    out = pair.join(q, "query", "inner").join(t, "target", "inner")
    s = F.coalesce("score", F.lit(0.0)) if dense else F.col("score")
    return out.select("query", "target", (s / F.sqrt(F.col("__q") * F.col("__t"))).alias("similarity"))


def cluster_representatives(stats: DataFrame, cluster="cluster", *, ptm="ptm", plddt="plddt", id_col="id") -> DataFrame:
    """Row with the largest ptm * plddt per cluster; the smaller id wins a tie."""
    rest = [c for c in stats.columns if c != cluster]
    pick = F.min(F.struct((-(F.col(ptm) * F.col(plddt))).alias("o"), F.col(id_col).alias("t"), F.struct(*rest).alias("row")))
    return stats.groupBy(cluster).agg(pick.alias("p")).select(cluster, "p.row.*")


def quality_bins(stats: DataFrame, *, ptm="ptm", plddt="plddt", length="len") -> DataFrame:
    """Counts and total length by 0.1 x 0.1 quality bin."""
    bins = [F.floor(F.round(F.col(c) * 10, 9)).alias(f"{c}_bin") for c in (ptm, plddt)]
    return stats.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("total_len"))


def hit_summary(hits: DataFrame, by=("design_id",), *, evalue="evalue", identity="identity", tm="tm_score", top=10, tie=()) -> DataFrame:
    """Per query: smallest E-value, best identity among E < 1, best TM score of the top hits."""
    from pyspark.sql import Window

    by = list(by)
    base = hits.groupBy(*by).agg(
        F.min(evalue).alias("min_evalue"), F.max(F.when(F.col(evalue) < 1, F.col(identity))).alias("max_identity"),
    )
    w = Window.partitionBy(*by).orderBy(evalue, *tie)
    best = hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).groupBy(*by).agg(F.max(tm).alias("max_tm_top"))
    return attach(base, best, by)


# ------------------------------------------------------------------- job fingerprint
_POLY = 0xEDB88320


def _times_x_to_8n(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Multiply reflected polynomials by x^(8 n) modulo the CRC-32 polynomial."""
    def step(v, times):  # multiply by x, ``times`` steps, on whole vectors
        for _ in range(times):
            v = np.where(v & 1, (v >> 1) ^ _POLY, v >> 1)
        return v

    def multiply(a, b):
        out = np.zeros_like(a)
        for bit in range(31, -1, -1):
            out = np.where((b >> bit) & 1, out ^ a, out)
            a = step(a, 1)
        return out

    power = step(np.full(1, 0x80000000, dtype=np.uint64), 8)  # x^8
    left = n.astype(np.uint64).copy()
    out = crc.astype(np.uint64)
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = multiply(out[odd], np.broadcast_to(power, (int(odd.sum()),)).copy())
        power = multiply(power, power)
        left >>= np.uint64(1)
    return out


def job_fingerprint(jobs: DataFrame, order: str = "row_idx", ligand="ligand", protein="protein_path") -> DataFrame:
    """CRC-32 of all ligand texts in job order followed by all protein texts.

    The texts are never joined: the checksum of a concatenation is the XOR of the parts'
    checksums, each shifted by the number of bytes that follow it, so a running length
    and a ``bit_xor`` aggregate give the same value.
    """
    parts = jobs.select(F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col(order).alias("at"), F.col(ligand).alias("text")),
        F.struct(F.lit(1).alias("side"), F.col(order).alias("at"), F.col(protein).alias("text")),
    )).alias("p")).select("p.*").where("text IS NOT NULL")
    sized = parts.select("side", "at", F.crc32(F.encode("text", "UTF-8")).alias("crc"), F.octet_length("text").cast("long").alias("n"))
    total = sized.agg(F.sum("n")).scalar()
    run = over_groups(sized, [], ["side", "at"], upto=("sum", "n"))

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(_times_x_to_8n(crc.to_numpy(), after.to_numpy()).astype("int64"))

    moved = run.withColumn("after", total - F.col("upto")).select(shifted("crc", "after").alias("crc"))
    return moved.agg(F.coalesce(F.bit_xor("crc"), F.lit(0).cast("long")).alias("fingerprint"))
