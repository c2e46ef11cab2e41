"""A session with the settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", *, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; everything else is left to the caller's ``conf``."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
