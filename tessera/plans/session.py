"""A session with the settings that the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """Adaptive plans, skew joins split, UTC; ``conf`` overrides, ``__`` in a name stands for a dot."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
