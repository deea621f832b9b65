"""Operator 2, exact duplicates: frequent digests are found first and settled by a small broadcast.

One row of each group of equal texts stays. A Misra-Gries summary (``DataFrame.freqItems``) names
every digest with more than ``support`` of all rows, and some more. What it names is counted
exactly; the winners, at most 1 / ``support`` of them, are broadcast, so that rows of frequent
texts never meet in one task. All other digests are grouped by an ordinary shuffle.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

#: Share of all rows from which a digest is frequent. The summary and the broadcast hold 1 / SUPPORT digests at most.
SUPPORT = 0.0005


def normal_text(text: Column | str) -> Column:
    """The text with each run of ASCII white space as one space; null as empty.

    Only runs that are not a single space already are replaced, which gives the same text.
    """
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def text_digest(text: Column | str) -> Column:
    """SHA-256 of the normalised text in UTF-8, lower-case hex."""
    return F.sha2(normal_text(text).cast("binary"), 256)


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT) -> DataFrame:
    """A row for each row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    ``row`` is ``monotonically_increasing_id`` over ``docs``. Of equal texts the row with the smallest
    id is kept; null ids come last, and of repeated rows with one id one is kept. Null texts count as
    empty, all empty texts are one group. An empty table gives no rows; other columns are not read.
    """
    row = F.monotonically_increasing_id().alias("row")
    return _groups(docs.select(row, F.col(id_column).alias("doc_id"), text_digest(text_column).alias("digest")), support)


def _groups(digests: DataFrame, support: float) -> DataFrame:
    digests = keep(digests)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    summary = [F.min(order).alias("winner"), F.count("*").alias("group_size")]
    #: At most 1 / support digests, as freqItems keeps no more counters; both broadcasts are bounded by that.
    named = digests.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    frequent = F.broadcast(keep(digests.join(F.broadcast(named), "digest").groupBy("digest").agg(*summary)))
    rare = digests.join(frequent, "digest", "left_anti")
    settled = digests.join(frequent, "digest").unionByName(rare.join(rare.groupBy("digest").agg(*summary), "digest"))
    return settled.select(
        "row",
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Losers, fewer than the rows, are taken away by row number. The numbered rows are written down, as files
    read twice may be split in another way.
    """
    row = "row number of exact dedup"
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    digests = numbered.select(F.col(row).alias("row"), F.col(id_column).alias("doc_id"), text_digest(text_column).alias("digest"))
    gone = _groups(digests, support).where("not kept").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)
