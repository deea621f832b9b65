"""Texts read whole from files: service descriptors, status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row per file below ``path``: ``(source, text)``. ``pattern`` is a glob on the file name."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
