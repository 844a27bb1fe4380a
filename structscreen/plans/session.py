"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A radius join is followed by an aggregate; splitting a crowded cell is worth the
    # extra exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A join whose partitions all turn out small is hashed instead of sorted; larger ones
    # keep the sort-merge form, which can spill.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows go to Python in batches of bounded size, whatever a row holds.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # What a task sorts is bounded: exchanges start with many partitions, which are joined up to a size and not to a number.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
}

# Settings a session must be built with: large plans are built faster when Python does
# not look up the call site of every column expression.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
