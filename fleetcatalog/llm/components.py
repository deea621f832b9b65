"""Connected components of a table of links, by stars that shrink (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of every node moved to its least neighbour: those of larger neighbours, or those of smaller ones and its own.

    The least neighbours are written down before they are joined, so that adaptive execution may split a node with very many links.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where("v < u")
    least = keep(seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")))
    joined = seen.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return keep(moved.where("u <> v").distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    several = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    above = links.select(F.col("v").alias("u")).distinct().join(links.select("u").distinct(), "u", "left_semi")
    return several.unionByName(above).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component for each node of ``links`` (u, v: long); a component is named by its least node. Links of a node with itself are left out."""
    now = keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(now):
        now = _star(_star(now, True), False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
