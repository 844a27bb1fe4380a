"""Regression on embeddings: PCA, nearest neighbours, forests."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structscreen.operators.metrics import spearman
from structscreen.plans.skew import attach


def fit_pca(train: DataFrame, k: int = 60, vec="vec"):
    """PCA model fitted on the train rows only."""
    return Pipeline(stages=[PCA(k=k, inputCol="features", outputCol="components")]).fit(with_features(train, vec))


def with_features(df: DataFrame, vec="vec") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


def apply_pca(model, df: DataFrame, vec="vec", out="components") -> DataFrame:
    moved = model.transform(with_features(df, vec)).drop("features")
    return moved.withColumn(out, vector_to_array("components")) if out == "components" else moved.withColumn(out, vector_to_array("components")).drop("components")


_CELLS = 4_000_000


def _nearest_in(x: np.ndarray, y: np.ndarray, order: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y for each row of x, ties by ``order``.

    A matrix product picks the candidates with room for its rounding; what is returned is measured on the
    vectors themselves.
    """
    step = max(1, _CELLS // max(len(y), 1))
    y2, found = (y * y).sum(axis=1), []
    for first in range(0, len(x), step):
        part = x[first:first + step]
        if p == 1:
            rough = np.zeros((len(part), len(y)))
            for c in range(x.shape[1]):
                rough += np.abs(part[:, c, None] - y[:, c])
            room = 1e-9 * rough
        else:
            x2 = (part * part).sum(axis=1)[:, None]
            rough = x2 + y2 - 2.0 * (part @ y.T)
            room = 1e-9 * (x2 + y2.max()) + np.zeros_like(rough)
        last = np.partition(rough, k - 1, axis=1)[:, k - 1:k] if k < len(y) else rough.max(axis=1, keepdims=True)
        near = rough <= last + room
        for row in range(len(part)):
            at = np.flatnonzero(near[row])
            d = np.abs(part[row] - y[at])
            d = d.sum(axis=1) if p == 1 else np.sqrt((d * d).sum(axis=1))
            best = np.lexsort((order[at], d))[:k]
            found.append((np.full(len(best), first + row), at[best], d[best]))
    return tuple(np.concatenate(c) for c in zip(*found))


def knn_vectors(queries: DataFrame, points: DataFrame, k: int, *, q_id="q_id", p_id="p_id", vec="vec", p=2, pivots=64, block=20_000) -> DataFrame:
    """Exact k nearest vectors without comparing every query with every point.

    Points go to the nearest of a fixed number of pivots (at most ``pivots`` rows, the only
    thing sent to every task).  With the radius of each pivot's cell the triangle inequality bounds
    the k-th distance of a query from above and each cell from below, and only cells that
    can hold a neighbour are visited.  Cells are cut into blocks of points and queries into chunks; each pair
    of them is one small matrix product in a task, which gives back ``k`` points per query.  In many
    dimensions nearly all pairs are measured, but none of them is a row.
    """
    order = F.xxhash64(F.col(p_id).cast("string"))
    rows = points.select(F.col(vec).alias("v"), order.alias("o"), F.col(p_id).alias("t")).orderBy("o", "t").limit(pivots).collect()
    places = np.array([list(r["v"]) for r in rows], dtype=float)  # at most ``pivots`` vectors
    if len(places) == 0:
        return queries.select(q_id).limit(0).select(q_id, F.lit(None).alias(p_id), F.lit(0.0).alias("distance"), F.lit(0).alias("neighbor_rank"))

    @F.pandas_udf("array<double>")
    def to_pivots(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        x = np.vstack(v.to_numpy()).astype(float)
        out = np.empty((len(x), len(places)))
        for i, place in enumerate(places):
            d = np.abs(x - place)
            out[:, i] = d.sum(axis=1) if p == 1 else np.sqrt((d * d).sum(axis=1))
        return pd.Series(list(out))

    cells = points.select(p_id, vec, to_pivots(vec).alias("__ds")).withColumn("__r", F.array_min("__ds"))
    cells = cells.select(p_id, vec, "__r", (F.array_position("__ds", F.col("__r")) - 1).cast("int").alias("__cell"))
    stats = cells.groupBy("__cell").agg(F.max("__r").alias("__radius"), F.count(F.lit(1)).alias("__n"))
    stats = stats.withColumn("__blocks", F.ceil(F.col("__n") / block))
    q = queries.select(q_id, vec, F.posexplode(to_pivots(vec)).alias("__cell", "__d"))
    q = attach(q, stats, ["__cell"], "inner", small=True)  # one row per pivot
    slack = F.lit(1e-9) + F.abs("__d") * 1e-12
    q = q.withColumns({"__high": F.col("__d") + F.col("__radius") + slack, "__low": F.col("__d") - F.col("__radius") - slack})
    # per query there is one row per pivot, which bounds this window
    w = Window.partitionBy(q_id).orderBy("__high").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = q.withColumn("__cum", F.sum("__n").over(w))
    q = q.withColumn("__bound", F.min(F.when(F.col("__cum") >= k, F.col("__high"))).over(Window.partitionBy(q_id)))
    visits = q.where(F.col("__bound").isNull() | (F.col("__low") <= F.col("__bound")))
    chunks = queries.agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).alias("__chunks"))
    visits = attach(visits, chunks, []).select(
        q_id, F.col(vec).cast("array<double>").alias("v"), "__cell", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"),
        F.pmod(F.xxhash64(F.col(q_id).cast("string")), F.col("__chunks")).alias("__chunk"),
    )
    blocked = attach(attach(cells, stats.select("__cell", "__blocks"), ["__cell"], "inner", small=True), chunks, []).select(
        p_id, F.col(vec).cast("array<double>").alias("v"), "__cell", F.pmod(F.xxhash64(F.col(p_id).cast("string")), F.col("__blocks")).alias("__block"),
        F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"),
    )
    schema = T.StructType([queries.schema[q_id], points.schema[p_id], T.StructField("distance", T.DoubleType())])

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            x, y = (t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
            order = np.unique(right[p_id].to_numpy(), return_inverse=True)[1]
            i, j, d = _nearest_in(x, y, order, k, p)
        else:
            i, j, d = (np.zeros(0, t) for t in ("int64", "int64", "float64"))
        return pa.table({q_id: left[q_id].take(pa.array(i)), p_id: right[p_id].take(pa.array(j)), "distance": d})

    key = ["__cell", "__block", "__chunk"]
    pairs = visits.groupBy(*key).cogroup(blocked.groupBy(*key)).applyInArrow(measure, schema)
    rank = Window.partitionBy(q_id).orderBy("distance", p_id)
    return pairs.withColumn("neighbor_rank", F.row_number().over(rank)).where(F.col("neighbor_rank") <= k)


def knn_regress(train: DataFrame, test: DataFrame, k: int, *, weights="uniform", p=2, id_col="id", vec="vec", target="y") -> DataFrame:
    """Prediction per test row: mean of its k nearest train targets, plain or 1/distance.

    With 1/distance weights, neighbours at distance 0 alone decide.
    """
    near = knn_vectors(test.select(F.col(id_col).alias("q_id"), vec), train.select(F.col(id_col).alias("p_id"), vec), k, p=p)
    near = near.join(train.select(F.col(id_col).alias("p_id"), F.col(target).alias("__y")), "p_id", "inner")
    if weights == "uniform":
        out = F.avg("__y")
    else:
        hit = F.avg(F.when(F.col("distance") == 0, F.col("__y")))
        inv = F.when(F.col("distance") > 0, F.lit(1.0) / F.when(F.col("distance") > 0, F.col("distance")))
        out = F.coalesce(hit, F.sum(F.col("__y") * inv) / F.sum(inv))
    return near.groupBy(F.col("q_id").alias(id_col)).agg(out.alias("prediction"))


def grid_search(train: DataFrame, test: DataFrame, grid: dict, *, vec="vec", target="y", folds=5, seed=0, id_col="id"):
    """Random-forest grid by cross-validated r2; (results table, hold-out Spearman table)."""
    data = with_features(train, vec)
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, seed=seed)
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(forest.getParam(name), values)
    maps = build.build()
    cv = CrossValidator(
        estimator=forest, estimatorParamMaps=maps, numFolds=folds, seed=seed,
        evaluator=RegressionEvaluator(labelCol=target, metricName="r2"),
    ).fit(data)
    rows = [
        (*[float(m[forest.getParam(g)]) for g in grid], float(s)) for m, s in zip(maps, cv.avgMetrics)
    ]
    schema = ", ".join([*[f"{g} double" for g in grid], "r2 double"])
    results = train.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("r2"))
    scored = cv.bestModel.transform(with_features(test, vec)).select(F.lit(1).alias("all"), F.col(target), "prediction")
    return results, spearman(scored, ["all"], target, "prediction").drop("all")
