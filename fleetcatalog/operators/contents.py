"""Catalog of contents by digest, and loads that change nothing when repeated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import artifact_name
from ..store import durable

READ_BYTES = 1 << 20


def digest(content: Column) -> Column:
    """Hex SHA-256 of binary content or of the UTF-8 bytes of a text."""
    return F.sha2(content.cast("binary"), 256)


def content_names(df: DataFrame, id_col: str, content: str, name: str) -> DataFrame:
    """``(id, digest, artifact)`` of each row: its digest, and its name with the digest put in."""
    rows = df.select(F.col(id_col).alias("id"), F.col(name).alias("name"), digest(F.col(content)).alias("digest"))
    return rows.select("id", "digest", artifact_name(F.col("name"), F.col("digest")).alias("artifact"))


def content_catalog(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """One row per distinct content: its digest, number of copies and lowest id.

    Only digests and ids are shuffled, and copies are counted before the shuffle, so a
    content with very many copies costs no more than any other.
    """
    return (
        df.select(F.col(id_col).alias("id"), digest(F.col(content)).alias("digest"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    )


def _digester():
    """The digest of files, as a function that tasks can run without this package installed."""
    from pyarrow import fs

    def one(root: str, rel_path: str) -> str:
        system, top = fs.FileSystem.from_uri(root)
        seen = hashlib.sha256()
        # The bytes as they are: without this, names such as x.gz would be read unpacked.
        with system.open_input_stream(f"{top.rstrip('/')}/{rel_path}", compression=None) as stream:
            while block := stream.read(READ_BYTES):
                seen.update(block)
        return seen.hexdigest()

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = zip(batch["root"], batch["rel_path"], strict=True)
            yield batch.assign(digest=[one(root, rel_path) for root, rel_path in pairs])

    return digests


def file_digests(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(root, rel_path, length)`` rows plus the hex SHA-256 and the artifact name of each file.

    Files are read in blocks inside the tasks, so a file may be of any size; only its path
    enters the task and only its digest leaves it. The number of tasks is fixed, as the few
    bytes of a path say nothing about the work behind it.
    """
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("root", "rel_path", "length").repartition(tasks, "root", "rel_path")
    digests = spread.mapInPandas(_digester(), "root string, rel_path string, length long, digest string")
    base = F.regexp_extract("rel_path", r"([^/]*)\z", 1)
    return digests.withColumn("artifact", artifact_name(base, F.col("digest")))


def file_catalog(digests: DataFrame) -> DataFrame:
    """One row per distinct file content, with copies and first path."""
    return digests.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("rel_path").alias("first_path")
    )


def new_contents(batch: DataFrame, catalog: DataFrame, id_col: str, content: str) -> DataFrame:
    """Contents of ``batch`` whose digest the catalog lacks: ``(digest, first_id)``.

    Two loads are the same when their digests are equal; within the batch the lowest id is kept.
    """
    fresh = (
        batch.select(F.col(id_col).alias("id"), digest(F.col(content)).alias("digest"))
        .groupBy("digest")
        .agg(F.min("id").alias("first_id"))
    )
    return fresh.join(catalog.select("digest").distinct(), "digest", "left_anti")


def load_contents(batch: DataFrame, catalog_path: str, id_col: str, content: str, load_id: str) -> DataFrame:
    """Adds the new contents of ``batch`` to the catalog table and returns the whole catalog.

    Each load owns the folder ``load=<load_id>`` and is compared with the other loads only, so
    running it again, after a failure or by mistake, writes the same rows to the same place.
    """
    spark = batch.sparkSession
    schema = f"digest string, first_id {dict(batch.dtypes)[id_col]}, load string"
    spark.createDataFrame([], schema).write.partitionBy("load").mode("append").parquet(catalog_path)
    others = spark.read.schema(schema).parquet(catalog_path).filter(F.col("load") != load_id)
    new = new_contents(batch, others, id_col, content)
    new.select("digest", "first_id").write.mode("overwrite").parquet(f"{catalog_path}/load={load_id}")
    return spark.read.schema(schema).parquet(catalog_path)


def create_catalog(spark: SparkSession, table: str, path: str, buckets: int, id_type: str = "bigint") -> None:
    """An empty catalog table ``(digest, first_id, load)`` at ``path``, kept in so many buckets by digest."""
    spark.sql(
        f"CREATE TABLE {table} (digest STRING, first_id {id_type}, load STRING) USING parquet "
        f"PARTITIONED BY (load) CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
    )


def _buckets(spark: SparkSession, table: str) -> int:
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Num Buckets'")
    return int(told.first()["data_type"])


def unknown_contents(batch: DataFrame, table: str, id_col: str, content: str, load_id: str) -> DataFrame:
    """Contents of ``batch`` that no other load of a catalog table has: ``(digest, first_id)``.

    The batch is dealt over the table's buckets, so the table is read where it lies and never shuffled,
    however often it is loaded into. Equal contents are one before that.
    """
    spark = batch.sparkSession
    fresh = batch.select(F.col(id_col).alias("id"), digest(F.col(content)).alias("digest")).groupBy("digest").agg(F.min("id").alias("first_id"))
    others = spark.table(table).filter(F.col("load") != load_id).select(F.col("digest").alias("known"))
    # A left join, as an anti join would be moved below the dealing. No two rows of the other loads are equal.
    dealt = fresh.repartition(_buckets(spark, table), "digest")
    joined = dealt.join(others.hint("merge"), F.col("digest") == F.col("known"), "left")
    return joined.filter(F.col("known").isNull()).select("digest", "first_id")


def load_catalog(batch: DataFrame, table: str, id_col: str, content: str, load_id: str) -> DataFrame:
    """Adds the unknown contents of ``batch`` to a catalog table as the load of that name, and returns the whole catalog.

    A load of the same name is replaced, so running it again changes nothing. What is new is written down
    before the table is touched.
    """
    spark = batch.sparkSession
    new, buckets = durable(unknown_contents(batch, table, id_col, content, load_id)), _buckets(spark, table)
    new.repartition(buckets, "digest").createOrReplaceTempView(f"{table}_new")
    name = load_id.replace("'", "\\'")
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (load = '{name}') SELECT digest, first_id FROM {table}_new")
    spark.catalog.dropTempView(f"{table}_new")
    return spark.table(table)
