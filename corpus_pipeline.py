"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetcatalog.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from fleetcatalog.llm.queries import read
from fleetcatalog.llm.store import held_out, keep


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees accept; the trees are fitted on those of ``docs`` that are labelled and not held out."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels"), lambda i: ~held_out(i, 4, 2)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a bin."""
    return packing.pack(packing.token_counts(docs))


STAGES = [
    ("quality", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Trees, near duplicates and best fit can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what lies between them is written as Parquet below ``spark.checkpoint.dir``, until ``release`` removes it."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs)
    return docs
