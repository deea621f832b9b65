"""What the operators share: tables written down, free column names, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import durable as keep
from ..store import release, shared_folder

__all__ = ["free_name", "held_out", "keep", "release", "shared_folder"]


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; never null."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % parts == part, F.lit(False))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with as many underscores as it takes to be none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
