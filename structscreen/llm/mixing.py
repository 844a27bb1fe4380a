"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (one value of every dimension: source, language, topic).  Raking
scales the cell weights to the target marginals of one dimension after the other until all agree.
A document of a cell is then kept with probability ``min(1, s * weight / tokens)`` of the cell,
where ``s`` is calibrated so that the expected kept tokens meet the budget; the draw is a hash of
the id, so it is the same on every run and machine.

Only the cell table is iterated.  Up to ``MAX_CELLS`` cells (counted first) it is raked in memory
on the driver and broadcast back; beyond, the same steps run as Spark aggregates and joins over a
written cell table, and documents meet it in an ordinary join.

Targets that no weights of the cells can meet (a value whose cells all lie where another target
wants none, say) leave a rest: ``off`` is the largest distance of a marginal from its target, as a share
of all tokens, and the same in every row.  Beyond ``TOLERANCE`` a strict call raises an error.

Defined cases: a null dimension is a value of its own; null tokens count as zero and negative ones
too; cells without tokens have weight zero and probability zero; targets for values that do not
occur are left out, values without a target keep none of their weight, and what is left is scaled
to the whole; a null id draws by the hash of its row (columns of maps apart); equal rows draw alike; other columns are
carried along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structscreen.llm.common import WORD_BREAKS, word_array, written

MAX_CELLS = 100_000
ROUNDS = 200
CLOSE = 1e-9
TOLERANCE = 1e-3
_ADDED = ("weight", "prob", "sampled", "off")

#: A dimension's targets: an exponent (target share ~ token share ** exponent) or value -> share.
Targets = dict[str, "float | dict[str | None, float]"]


def text_form(text: Column) -> Column:
    """A coarse topic of a text by its form: ``empty``, ``list``, ``note``, ``article`` or ``book``."""
    words = F.size(word_array(text))
    lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.char_length(F.translate(x, WORD_BREAKS, "")) > 0))
    return (
        F.when(words == 0, "empty").when((lines > 1) & (words < 8 * lines), "list").when(words < 150, "note").when(words < 1500, "article").otherwise("book")
    )


def cell_table(df: DataFrame, dims: list[str], tokens_col: str) -> DataFrame:
    """(dims.., t): tokens per cell."""
    return df.groupBy(*dims).agg(F.sum(F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)).cast("double"), F.lit(0.0))).alias("t"))


def target_of(sums: dict, wanted: "float | dict") -> dict:
    """Target tokens per value, for the token sums of a dimension."""
    total = sum(sums.values())
    share = {k: (v ** wanted if v > 0 else 0.0) for k, v in sums.items()} if isinstance(wanted, (int, float)) else {k: float(wanted.get(k, 0.0)) if v > 0 else 0.0 for k, v in sums.items()}
    whole = sum(share.values())
    return {k: total * v / whole if whole > 0 else 0.0 for k, v in share.items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: list["float | dict"], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Cell weights whose marginals meet the targets, and by how much they miss them at most; ``cells`` holds one value per dimension."""
    off, whole = 0.0, max(1.0, float(tokens.sum()))
    weights = tokens.astype(np.float64).copy()
    places, goals = [], []
    for k, wanted in enumerate(targets):
        values = {v: i for i, v in enumerate(dict.fromkeys(c[k] for c in cells))}
        at = np.array([values[c[k]] for c in cells], dtype=np.int64)
        goal = target_of(dict(zip(values, np.bincount(at, tokens, len(values)).tolist())), wanted)
        places.append(at)
        goals.append(np.array([goal[v] for v in values]))
    for _ in range(rounds):
        for at, goal in zip(places, goals):
            sums = np.bincount(at, weights, len(goal))
            weights *= np.divide(goal, sums, out=np.zeros(len(goal)), where=sums > 0)[at]
        off = max(float(np.abs(np.bincount(at, weights, len(goal)) - goal).max(initial=0.0)) for at, goal in zip(places, goals))
        if off <= CLOSE * whole:
            break
    return weights, off / whole


def scale_to_budget(tokens: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """``s`` with sum of min(tokens, s * weights) = budget (or as much as there is)."""
    live = (tokens > 0) & (weights > 0)
    tokens, weights = tokens[live], weights[live]
    if not len(tokens) or budget <= 0:
        return 0.0
    order = np.argsort(tokens / weights)  # the cells that fill up first
    tokens, weights = tokens[order], weights[order]
    full, open_weight = np.concatenate(([0.0], np.cumsum(tokens))), weights.sum() - np.concatenate(([0.0], np.cumsum(weights)))
    for k in range(len(tokens)):
        s = (budget - full[k]) / max(open_weight[k], 1e-300)
        if s <= tokens[k] / weights[k]:
            return float(s)
    return float((tokens / weights)[-1])


def _rake_distributed(cells: DataFrame, dims: list[str], targets: list["float | dict"], rounds: int) -> tuple[DataFrame, float]:
    """As ``rake`` for a cell table of any size: (dims.., t, w)."""
    off = 0.0
    total = cells.agg(F.sum("t")).first()[0] or 0.0
    now = written(cells.withColumn("w", F.col("t")))
    for k, wanted in enumerate(targets):
        sums = now.groupBy(dims[k]).agg(F.sum("t").alias("v"))
        if isinstance(wanted, (int, float)):
            share = F.when(F.col("v") > 0, F.pow("v", F.lit(float(wanted)))).otherwise(0.0)
        else:
            share = F.lit(0.0)
            for value, part in wanted.items():
                share = F.when(F.col(dims[k]).eqNullSafe(F.lit(value)) & (F.col("v") > 0), float(part)).otherwise(share)
        shares = written(sums.select(F.col(dims[k]).alias("_k"), share.alias("_s")))
        whole = shares.agg(F.sum("_s")).first()[0] or 0.0
        goal = shares.select("_k", (F.col("_s") * F.lit(total / whole if whole > 0 else 0.0)).alias(f"_g{k}"))
        now = now.join(goal, F.col(dims[k]).eqNullSafe(F.col("_k"))).drop("_k")
    now = written(now)
    for _ in range(rounds):
        for k, dim in enumerate(dims):
            sums = now.groupBy(F.col(dim).alias("_k")).agg(F.sum("w").alias("_v"))
            joined = now.join(sums, F.col(dim).eqNullSafe(F.col("_k")))
            now = joined.withColumn("w", F.when(F.col("_v") > 0, F.col("w") * F.col(f"_g{k}") / F.col("_v")).otherwise(0.0)).drop("_k", "_v")
        now = written(now)  # one written table a round
        off = 0.0
        for k, dim in enumerate(dims):
            worst = now.groupBy(dim).agg(F.abs(F.sum("w") - F.max(f"_g{k}")).alias("d")).agg(F.max("d")).first()[0]
            off = max(off, worst or 0.0)
        if off <= CLOSE * max(1.0, total):
            break
    return now.select(*dims, "t", "w"), off / max(1.0, total)


def _scale_distributed(cells: DataFrame, budget: float) -> float:
    low, high = 0.0, cells.where("w > 0").agg(F.max(F.col("t") / F.col("w"))).first()[0] or 0.0
    for _ in range(60):
        middle = (low + high) / 2
        kept = cells.agg(F.sum(F.least(F.col("t"), F.lit(middle) * F.col("w")))).first()[0] or 0.0
        low, high = (middle, high) if kept < budget else (low, middle)
    return high


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), id_col))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(df: DataFrame, targets: Targets, tokens_col: str, fraction: float = 0.5, id_col: str = "doc_id", seed: int = 42, max_cells: int = MAX_CELLS, strict: bool = False) -> DataFrame:
    """``df`` with ``weight`` (raked share per token), ``prob``, ``sampled`` and ``off``; columns of these names are replaced.

    ``fraction`` of all tokens is the budget; ``strict`` raises an error if ``off`` is beyond ``TOLERANCE``.
    """
    dims = list(targets)
    keys = {d: f"_d{k}" for k, d in enumerate(dims)}
    base = df.select(*[F.col(c) for c in df.columns if c not in _ADDED])
    named = base.withColumns({key: F.col(d).cast("string") for d, key in keys.items()})
    cells = written(cell_table(named, list(keys.values()), tokens_col))
    if cells.limit(max_cells + 1).count() <= max_cells:
        rows = sorted(cells.collect(), key=lambda r: tuple((v is not None, v or "") for v in r[:-1]))
        tokens = np.array([r["t"] for r in rows], dtype=np.float64)
        weights, off = rake([tuple(r[:-1]) for r in rows], tokens, list(targets.values()))
        s = scale_to_budget(tokens, weights, fraction * tokens.sum())
        share = np.divide(weights, tokens, out=np.zeros(len(rows)), where=tokens > 0)
        schema = ", ".join(f"k{i} string" for i in range(len(dims))) + ", weight double, prob double"
        found = df.sparkSession.createDataFrame([(*r[:-1], float(a), float(min(1.0, s * a))) for r, a in zip(rows, share)], schema)
        found = F.broadcast(found)  # at most max_cells rows
    else:
        raked, off = _rake_distributed(cells, list(keys.values()), list(targets.values()), ROUNDS)
        total = cells.agg(F.sum("t")).first()[0] or 0.0
        s = _scale_distributed(raked, fraction * total)
        share = F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0)
        found = raked.select(*[F.col(key).alias(f"k{i}") for i, key in enumerate(keys.values())], share.alias("weight"), F.least(F.lit(1.0), F.lit(s) * share).alias("prob"))
    on = [F.col(key).eqNullSafe(F.col(f"k{i}")) for i, key in enumerate(keys.values())]
    if strict and off > TOLERANCE:
        raise ValueError(f"no weights of the cells meet the targets of {', '.join(dims)}: a marginal is off by {off:.3g} of all tokens")
    row = F.xxhash64(*[F.col(f.name) for f in base.schema if "map<" not in f.dataType.simpleString()])
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), row.cast("string")))
    joined = named.join(found, on)
    return joined.select(*base.columns, "weight", "prob", (draw(name, seed) < F.col("prob")).alias("sampled"), F.lit(off).alias("off"))
