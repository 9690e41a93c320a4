"""A session with the settings that the engine's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM compiles no larger methods, and wide projections run many times slower without
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # joins that make many rows of few bytes still use all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # row_number() <= K is pushed below the shuffle up to this K
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def session(name: str = "kinforge", **settings: str) -> SparkSession:
    """The running session or a new one, with the settings above and any more."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
