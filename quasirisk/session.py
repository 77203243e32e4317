"""A session with the settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quasirisk", **settings: str) -> SparkSession:
    """Adaptive execution on; everything else is left to the cluster's configuration.

    Sort-merge joins turn into hash joins at run time where every partition is small.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
