"""Byte units and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of ten and binary shifts per unit.
DECIMAL_UNITS = {"KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}
BINARY_UNITS = {"KiB": 10, "MiB": 20, "GiB": 30, "TiB": 40}


def decimal_bytes(value: Column, unit: str) -> Column:
    """Bytes of ``value`` given in KB, MB, GB or TB."""
    return value.cast("long") * F.lit(DECIMAL_UNITS[unit]).cast("long")


def binary_bytes(value: Column, unit: str) -> Column:
    """Bytes of ``value`` given in KiB, MiB, GiB or TiB."""
    return F.shiftleft(value.cast("long"), BINARY_UNITS[unit])


def round_up_kib(size: Column) -> Column:
    """``size`` rounded up to whole KiB, with one KiB as the least."""
    below = F.greatest(size.cast("long") - 1, F.lit(0).cast("long"))
    return F.shiftleft(F.shiftright(below, 10), 10) + 1024


def whole_seconds(millis: Column) -> Column:
    """Whole seconds in ``millis``: truncated, never below one."""
    seconds = F.call_function("div", millis.cast("long"), F.lit(1000).cast("long"))
    return F.greatest(F.lit(1).cast("long"), seconds)
