"""Incremental runs over files and event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structscreen.operators.tables import pending
from structscreen.plans.checks import must_be_empty
from structscreen.sources.tables import PREDICTION_SCHEMA, batch_files, batch_of


def process_incremental(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, key="name", once=True):
    """Process new rows in micro-batches; a restart goes on where the run stopped.

    Each batch first drops the keys that are already in ``out`` and then writes under its
    own batch folder in overwrite mode, so a batch that is run again after a crash gives
    the same rows once.  Equal rows of a batch count once; different rows of one key are an
    error, since nothing says which of them holds.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jobs = batch.distinct()
        twice = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        jobs = jobs.unionByName(must_be_empty(twice, F.concat(F.lit("different rows for "), F.col(key).cast("string")), jobs))
        try:
            done = spark.read.parquet(out).where(F.col("batch_id") != batch_id).select(key)
            jobs = pending(jobs, done, key=key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fn(jobs).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_predictions(spark: SparkSession, root: str, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """Prediction files of screening batches as they land, with batch and file time.

    ``schema`` must name the columns of the files; another header is an error.
    """
    files = spark.readStream.schema(schema).option("header", "true").option("enforceSchema", "false").csv(batch_files(root))
    return files.select(
        *files.columns, batch_of(F.col("_metadata.file_path")).alias("batch"),
        F.col("_metadata.file_modification_time").alias("landed"),
    )


def stream_merge(preds: DataFrame, inputs: DataFrame, *, delay="1 hour") -> DataFrame:
    """Stream of predictions joined to the (static) batch inputs, each (batch, name) once.

    The state holds the keys of the last ``delay`` of file times only.
    """
    unique = preds.withWatermark("landed", delay).dropDuplicatesWithinWatermark(["batch", "name"])
    renamed = unique.select(
        "batch", F.get(F.split("name", "_"), F.lit(1)).try_cast("long").alias("row_idx"),
        F.col("affinity").alias("affinity_pred"),
    )
    return renamed.join(inputs, ["batch", "row_idx"], "inner")


def stream_meter(stream: DataFrame, metrics, *, time="ts", window="1 day", delay="1 hour", t="t", bins=10, by=()) -> DataFrame:
    """Means of metrics per tumbling window and bin; rows later than ``delay`` are dropped."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    keyed = stream.withColumn("bin", F.bround(F.col(t) * (bins - 1)).cast("int")).withWatermark(time, delay)
    out = keyed.groupBy(F.window(time, window).alias("w"), *by, "bin").agg(
        *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n")
    )
    return out.select(F.col("w.start").alias("window_start"), *by, "bin", *metrics, "n")
