"""Tables that a job writes down and reads again, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine without that setting gets a folder made for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fleetcatalog-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read from there.

    For rows that are read more than once and are costly to find, or that must stay the same
    when read again after an executor was lost. The size of the table is known to the planner.
    ``release`` removes it. ``compression`` is Parquet's: ``zstd`` for tables of very many small rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes the folder that a table was written to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> int:
    """Removes the tables written so far in this application, and says how many; call it when the results are stored."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)
