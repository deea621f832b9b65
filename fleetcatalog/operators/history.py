"""Histories: compatibility changes, last events, status counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import previous_value

SALTS = 256


def compat_history(df: DataFrame, name: str, seq: Sequence[str], compat: str) -> DataFrame:
    """``df`` plus ``previous``, the compatibility version before it of the same name, and ``changed``.

    Any difference is a change; the first of a name has no previous one and is none.
    """
    lagged = previous_value(df, [name], seq, compat, "previous")
    return lagged.withColumn(
        "changed", F.coalesce(F.col("previous") != F.col(compat), F.lit(False))
    )


def event_tail(df: DataFrame, key: str, ts: str, event_id: str, n: int, salts: int = SALTS) -> DataFrame:
    """The last ``n`` events of each key, ties by id, with ``rank`` 1 for the last.

    Each input partition keeps the last ``n`` of each key. These are ranked in groups of input
    partitions first, so that a key of any size leaves at most ``salts`` x ``n`` rows for the
    second ranking. How the partitions are grouped does not matter to the result. Spark limits
    below the shuffle for ``n`` up to ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    order = [F.col(ts).desc(), F.col(event_id).desc()]
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    within = Window.partitionBy(key, "_salt").orderBy(*order)
    some = salted.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= n)
    overall = Window.partitionBy(key).orderBy(*order)
    return some.drop("rank", "_salt").withColumn("rank", F.row_number().over(overall)).filter(F.col("rank") <= n)


def event_time(ts: Column, date: bool = False, utc: bool = True, zone: str = "UTC") -> Column:
    """Display text of a UTC timestamp without zone: the time, led by the date if asked, in UTC or ``zone``.

    The zone of the session has no say in it.
    """
    shown = ts if utc else F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    text = shown.cast("timestamp_ntz").cast("string")
    return F.substring(text, 1, 19) if date else F.substring(text, 12, 8)


def status_rollup(df: DataFrame, name: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Rows per name in each of the given statuses; 0 where there are none."""
    return df.groupBy(name).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses])
