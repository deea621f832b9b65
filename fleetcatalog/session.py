"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution merges small partitions, splits skewed joins and picks join sides by
# measured size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", name: str = "fleetcatalog", **settings: str) -> SparkSession:
    """A session on this machine, for tests and timing."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
