"""Prediction quality, meters, classifiers, variant scores, embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structscreen.functions.text import draw
from structscreen.plans.skew import attach, avg_rank, over_groups


def spearman(df: DataFrame, by, a: str, b: str, out="spearman") -> DataFrame:
    """Correlation of average ranks per group; rows with a missing side do not count."""
    by = list(by)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("__a"), F.col(b).alias("__b"))
    ranked = avg_rank(avg_rank(rows, by, "__a", "__ra"), by, "__b", "__rb")
    return ranked.groupBy(*by).agg(F.corr("__ra", "__rb").alias(out))


def validation_metrics(df: DataFrame, by=(), *, truth="truth", pred="pred", rmsd: str | None = None, unknown: float | None = None, name="value") -> DataFrame:
    """rmse, base rmse, Pearson, Spearman, and shares below 2 and 5; zeros when empty.

    Rows whose truth equals ``unknown`` are left out of the correlations and errors.
    """
    by = list(by)
    good = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    if unknown is not None:
        good = good & (F.col(truth) != F.lit(float(unknown)))
    t, p = F.when(good, F.col(truth)), F.when(good, F.col(pred))
    aggs = [
        F.sqrt(F.avg((t - p) * (t - p))).alias(f"{name}_rmse"),
        F.stddev_pop(t).alias(f"{name}_base_rmse"), F.corr(t, p).alias(f"{name}_pearson"),
    ]
    if rmsd:
        aggs += [(F.avg(F.when(F.col(rmsd) < lim, 100.0).otherwise(0.0))).alias(f"rmsds_lt{lim}") for lim in (2, 5)]
    base = df.groupBy(*by).agg(*aggs)
    rho = spearman(df.where(good), by, truth, pred, f"{name}_spearman")
    out = attach(base, rho, by)
    return out.na.fill(0.0, [c for c in out.columns if c not in by])


def meter(df: DataFrame, metrics, by=(), *, t: str | None = None, bins=10) -> DataFrame:
    """Means of metrics, per bin of ``t`` in [0, 1] if given (bin = half-even round of 9 t)."""
    keys = list(by)
    if t is not None:
        df = df.withColumn("bin", F.bround(F.col(t) * (bins - 1)).cast("int"))
        keys.append("bin")
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def bce_with_logits(label: Column, logit: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def classifier_metrics(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """accuracy (score > 0), ROC AUC (0 for one class), positive share, loss.

    The AUC is the rank-sum form, from average ranks.
    """
    by = list(by)
    y, s = F.col(label).cast("double"), F.col(score)
    rows = avg_rank(df, by, score, "__rank")
    pos = F.sum(y)
    neg = F.count(F.lit(1)) - pos
    out = rows.groupBy(*by).agg(
        F.avg((y == (s > 0).cast("double")).cast("double")).alias("accuracy"),
        F.avg(bce_with_logits(y, s)).alias("loss"), F.avg(y).alias("positive_share"),
        F.sum(F.when(y == 1, F.col("__rank"))).alias("__rs"), pos.alias("__p"), neg.alias("__n"),
    )
    auc = (F.col("__rs") - F.col("__p") * (F.col("__p") + 1) / 2) / (F.col("__p") * F.col("__n"))
    one_class = (F.col("__p") == 0) | (F.col("__n") == 0)
    return out.withColumn("roc_auc", F.when(one_class, F.lit(0.0)).otherwise(auc)).drop("__rs", "__p", "__n")


def mean_absolute_deviation(df: DataFrame, col: str, by=()) -> DataFrame:
    """Baseline of a regression: mean distance from the mean."""
    by = list(by)
    mean = df.groupBy(*by).agg(F.avg(col).alias("__m"))
    return attach(df, mean, by, "inner").groupBy(*by).agg(F.avg(F.abs(F.col(col) - F.col("__m"))).alias("baseline"))


def rmsd_labels(df: DataFrame, cutoffs, rmsd="rmsd") -> DataFrame:
    """Success label and one-hot bin by a list of cutoffs ([lo, hi), the last one open)."""
    edges = [0.0, *[float(c) for c in cutoffs]]
    highs = [*[float(c) for c in cutoffs], float("inf")]
    r = F.col(rmsd)
    one_hot = F.array(*[F.when((r >= lo) & (r < hi), 1).otherwise(0) for lo, hi in zip(edges, highs)])
    return df.withColumn("success", F.when(r < edges[1], 1).otherwise(0)).withColumn("rmsd_bins", one_hot)


def masked_mse(df: DataFrame, by=(), *, truth="truth", pred="pred", unknown=-1.0) -> DataFrame:
    """Mean over all rows of the squared error, where rows with unknown truth add 0."""
    m = (F.col(truth) != F.lit(float(unknown))).cast("double")
    err = (F.col(pred) - F.col(truth)) * (F.col(pred) - F.col(truth)) * m / (m + F.lit(1e-6))
    return df.groupBy(*by).agg(F.avg(err).alias("masked_mse"))


def circular_error(df: DataFrame, by=(), *, pred="pred", truth="truth", mask="mask", symmetric="symmetric", weight: str | None = None) -> DataFrame:
    """3 * masked mean of 1 - cos of the angle error; half-turn symmetric angles take the better."""
    d = F.col(pred) - F.col(truth)
    plain = F.lit(1.0) - F.cos(d)
    turned = F.lit(1.0) - F.cos(d - F.lit(3.141592653589793))
    loss = F.when(F.col(symmetric) == 1, F.least(plain, turned)).otherwise(plain)
    w = F.col(weight) if weight else F.lit(1.0)
    m = F.col(mask)
    return df.groupBy(*by).agg((F.sum(loss * w * m) / (F.sum(m) + F.lit(1e-12)) * 3.0).alias("circular_error"))


# ------------------------------------------------------------------- likelihoods, variants
def log_softmax(df: DataFrame, by, value="logit", out="log_prob") -> DataFrame:
    """value - max - ln(sum(exp(value - max))) over the symbols of one position.

    A position has one row per vocabulary symbol, which bounds the window.
    """
    w = Window.partitionBy(*by)
    top = df.withColumn("__m", F.max(value).over(w))
    shifted = F.col(value) - F.col("__m")
    return top.withColumn(out, shifted - F.log(F.sum(F.exp(shifted)).over(w))).drop("__m")


def mean_ll(df: DataFrame, by=("id",), *, ll="log_prob", mask: str | None = None) -> DataFrame:
    """Mean log-likelihood over unmasked positions, and perplexity exp(-ll)."""
    value = F.col(ll) if mask is None else F.when(F.col(mask), F.col(ll))
    return df.groupBy(*by).agg(F.avg(value).alias("mean_ll")).withColumn("perplexity", F.exp(-F.col("mean_ll")))


def parse_mutation(df: DataFrame, col="mutant", offset=0) -> DataFrame:
    """wild type, 0-based position and mutant of codes like A12B."""
    pattern = r"^(.)(\d+)(.)$"
    return df.withColumns({
        "wt": F.regexp_extract(col, pattern, 1), "mt": F.regexp_extract(col, pattern, 3),
        "pos": F.regexp_extract(col, pattern, 2).try_cast("long") - offset,
    })


def variant_scores(mutations: DataFrame, log_probs: DataFrame, sequences: DataFrame, by=("id",), *, offset=0, extra=()) -> DataFrame:
    """log p(mutant) - log p(wild type) at the mutated position.

    ``log_probs``: by, pos (0-based), symbol, log_prob [, extra such as model].  The listed
    wild type must be the one in the sequence, else the job fails.
    """
    by, extra = list(by), list(extra)
    m = attach(parse_mutation(mutations, offset=offset), sequences.select(*by, F.col("sequence").alias("__s")), by, "inner")
    found = F.substr("__s", F.col("pos") + 1, F.lit(1))
    wt = F.when(found == F.col("wt"), F.col("wt")).otherwise(
        F.raise_error(F.concat(F.lit("wild type does not match the sequence: "), F.col("mutant"))).cast("string")
    )
    m = m.withColumn("wt", wt).drop("__s")
    lp = log_probs.select(*by, *extra, "pos", "symbol", "log_prob")
    a = m.join(lp.withColumnRenamed("symbol", "wt").withColumnRenamed("log_prob", "__wt"), [*by, "pos", "wt"], "inner")
    b = a.join(lp.withColumnRenamed("symbol", "mt").withColumnRenamed("log_prob", "__mt"), [*by, *extra, "pos", "mt"], "inner")
    return b.withColumn("score", F.col("__mt") - F.col("__wt")).drop("__wt", "__mt")


def ensemble_columns(scores: DataFrame, keys, models, model="model", value="score") -> DataFrame:
    """One score column per model."""
    return scores.groupBy(*keys).pivot(model, list(models)).agg(F.first(value))


def pseudo_likelihood(sequences: DataFrame, log_probs: DataFrame, by=("id",)) -> DataFrame:
    """Sum of log p of the sequence symbol at token positions 1 .. length-2."""
    chars = F.filter(F.split("sequence", ""), lambda c: c != "")
    rows = sequences.select(*by, F.length("sequence").alias("__n"), F.posexplode(chars).alias("pos", "symbol"))
    rows = rows.where((F.col("pos") >= 1) & (F.col("pos") <= F.col("__n") - 2)).withColumn("pos", F.col("pos").cast("long"))
    return rows.join(log_probs, [*by, "pos", "symbol"], "inner").groupBy(*by).agg(F.sum("log_prob").alias("pseudo_ll"))


def rho_report(df: DataFrame, by=("protein",), *, truth="truth", pred="pred", n_boot=20, seed=0, key="row_id") -> DataFrame:
    """|Spearman| per group with mean and population deviation over bootstrap replicates.

    A replicate draws as many row numbers as the group has rows, with replacement, by a
    reproducible hash; drawn numbers meet the rows in an equi-join.
    """
    by = list(by)
    rows = over_groups(df.select(*by, key, truth, pred), by, [key], __i=("row_number",))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    reps = attach(rows.select(*by, "__i"), sizes, by, "inner").withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    drawn = reps.select(*by, "__rep", (F.pmod(draw(seed, F.col("__rep"), F.col("__i")), F.col("__n")) + 1).alias("__i"))
    boot = drawn.join(rows, [*by, "__i"], "inner")
    rho = spearman(boot, [*by, "__rep"], truth, pred, "r").groupBy(*by).agg(
        F.avg(F.abs("r")).alias("boot_mean"), F.stddev_pop(F.abs("r")).alias("boot_std")
    )
    full = spearman(rows, by, truth, pred, "r").select(*by, F.abs("r").alias("rho"))
    return attach(full, rho, by)


# ---------------------------------------------------------------------------- embeddings
def pool_embeddings(tokens: DataFrame, by=("label", "layer"), *, include="mean", truncate: int | None = None, pos="pos", vec="vec") -> DataFrame:
    """Per-sequence embeddings from token rows; position 0 is the begin symbol.

    'mean' averages positions 1..L with one vector aggregate (partial sums before the
    shuffle), 'bos' is the begin symbol's row, 'per_tok' the rows of positions 1..L.
    """
    if include == "bos":
        return tokens.where(F.col(pos) == 0).select(*by, vec)
    rows = tokens.where(F.col(pos) >= 1)
    if truncate is not None:
        rows = rows.where(F.col(pos) <= truncate)
    if include == "per_tok":
        return rows.select(*by, pos, vec)
    mean = Summarizer.mean(array_to_vector(F.col(vec)))
    return rows.groupBy(*by).agg(vector_to_array(mean).alias(vec))
