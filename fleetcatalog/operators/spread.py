"""Ordered work over groups of any size.

A window by group would put each group into one task. Here rows are range-partitioned by (group,
order) into slices, written down, and worked on slice by slice. Only groups that go on from one
slice into the next need more: what the slices before them add up to, one row per slice border.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import durable

__all__ = ["durable", "prefixed", "previous_value", "running_total", "same"]


def same(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Null-safe equality of all pairs."""
    return reduce(lambda a, b: a & b, [left.eqNullSafe(right) for left, right in pairs])


def prefixed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    """``df`` with ``names`` renamed, for joins of a frame with one derived from it."""
    return df.withColumnsRenamed({name: prefix + name for name in names})


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None) -> DataFrame:
    """``df`` with the ``_slice`` of each row; as many as shuffles have partitions, if not said."""
    columns = [*keys, *[c for c in order if c not in keys]]
    ranged = df.repartitionByRange(*columns) if slices is None else df.repartitionByRange(slices, *columns)
    return durable(ranged.withColumn("_slice", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    weight: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """``df`` plus the sum of ``weight`` (1 if not given) up to and with each row of its group.

    ``order`` must be total within a group. Without a weight the sum is the row's position from 1.
    """
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    sliced = _sliced(df, keys, order, slices)
    names = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*names).agg(F.sum(amount).alias("_sum"))
    # A group that began in an earlier slice is the first of its slice, so there is one row per slice at most.
    offsets = sums.withColumn("_offset", F.sum("_sum").over(before)).filter(F.col("_offset").isNotNull()).drop("_sum")
    offsets = F.broadcast(prefixed(offsets, names, "_o_"))
    inner = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = sliced.withColumn(out, F.sum(amount).over(inner)).join(
        offsets, same([(F.col(n), F.col("_o_" + n)) for n in names]), "left"
    )
    total = (F.col(out) + F.coalesce("_offset", F.lit(0))).alias(out)
    return joined.select(*[total if c == out else c for c in [*df.columns, out]])


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    slices: int | None = None,
) -> DataFrame:
    """``df`` plus the ``value`` of the row before it in its group, null for the first."""
    sliced = _sliced(df, keys, order, slices)
    names = [*keys, "_slice"]
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    last = sliced.groupBy(*names).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    # One row per slice at most, as above.
    carried = last.withColumn("_carry", F.lag("_last").over(by_slice)).drop("_last").filter(F.col("_carry").isNotNull())
    carried = F.broadcast(prefixed(carried, names, "_l_"))
    inner = Window.partitionBy("_slice", *keys).orderBy(*order)
    joined = (
        sliced.withColumn("_first", F.row_number().over(inner) == 1)
        .withColumn(out, F.lag(value).over(inner))
        .join(carried, same([(F.col(n), F.col("_l_" + n)) for n in names]), "left")
    )
    found = F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.col(out)).alias(out)
    return joined.select(*[found if c == out else c for c in [*df.columns, out]])
