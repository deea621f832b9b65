"""Route rules of endpoints, flattened and typed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import known_method, typed_path
from ..functions.fixed import FAMILIES


def _requests(acl: Column) -> Column:
    """All requests of an access rule, as one list of one struct type.

    HTTP requests keep their order and repeats; ports are a set.
    """
    http = F.transform(
        F.coalesce(acl["http"], F.array()),
        lambda r: F.struct(
            r["method"].alias("method"),
            r["path"].alias("path"),
            r["is_regex"].alias("is_regex"),
            r["rewrite"].alias("rewrite"),
            F.lit(None).cast("int").alias("port"),
        ),
    )
    ports = F.transform(
        F.array_sort(F.array_distinct(F.coalesce(acl["ports"], F.array()))),
        lambda p: F.struct(
            F.lit(None).cast("string").alias("method"),
            F.lit(None).cast("string").alias("path"),
            F.lit(None).cast("boolean").alias("is_regex"),
            F.lit(None).cast("string").alias("rewrite"),
            p.cast("int").alias("port"),
        ),
    )
    return F.concat(http, ports)


def typed_rules(df: DataFrame, path: str = "path", is_regex: str = "is_regex") -> DataFrame:
    """``df`` plus ``kind``, ``value`` and ``error`` of each row's path."""
    typed = typed_path(F.col(path), F.col(is_regex))
    return df.withColumn("_typed", typed).select(*df.columns, "_typed.*")


def route_rules(
    endpoints: DataFrame, keys: Sequence[str] = ("bundle", "label"), strict: bool = False
) -> DataFrame:
    """One row per rule of every endpoint, in order, with its type.

    ``(keys, acl_pos, request_pos, family, method, kind, value, rewrite, port, error)``. A rule
    that may not be (bad prefix, unknown method) has an ``error``, or fails the job if ``strict``.
    An endpoint without rules gives no row. Each endpoint row is flattened where it lies.
    """
    acls = endpoints.select(*keys, F.posexplode("acls").alias("acl_pos", "acl"))
    rules = acls.select(
        *keys,
        "acl_pos",
        F.col("acl.family").alias("family"),
        F.posexplode(_requests(F.col("acl"))).alias("request_pos", "r"),
    ).select(*keys, "acl_pos", "request_pos", "family", "r.*")
    typed = rules.withColumn(
        "_typed", F.when(F.col("port").isNull(), typed_path(F.col("path"), F.col("is_regex")))
    )
    bad_method = F.col("method").isNotNull() & ~known_method(F.col("method"))
    error = F.coalesce(
        F.when(bad_method, F.concat(F.col("method"), F.lit(" is not a known method"))), F.col("_typed.error")
    )
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    return typed.select(
        *keys,
        "acl_pos",
        "request_pos",
        "family",
        "method",
        F.when(F.col("port").isNotNull(), "port").otherwise(F.col("_typed.kind")).alias("kind"),
        F.col("_typed.value").alias("value"),
        "rewrite",
        "port",
        error.alias("error"),
    )


def acl_listing(rules: DataFrame, family: str) -> DataFrame:
    """Rules of one protocol family."""
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {', '.join(FAMILIES)}")
    return rules.filter(F.col("family") == family)
