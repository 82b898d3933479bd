"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # runtime re-planning: coalesce small shuffle partitions, split skewed join partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # 2-D metrics of a sweep are tens of MB; beyond this size joins shuffle
    "spark.sql.autoBroadcastJoinThreshold": "128MB",
    # dictionary-coded metrics grow in memory: sizes on disk count four times against the threshold
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Builder with the recommended settings; master and memory stay the caller's."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
