"""Default endpoints, and three ways in which one set of endpoints replaces another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.fixed import DEFAULT_LABEL, DEFAULT_SERVICE_PORT
from .spread import prefixed, same


ACLS = (
    "array<struct<family:string,http:array<struct<method:string,path:string,is_regex:boolean,"
    "rewrite:string>>,ports:array<int>>>"
)
# Lists whose order counts.
ORDERED = ("http",)


def _as_set(value: Column, kind: DataType) -> Column:
    """``value`` with the lists in it sorted and without repeats, all but those in the fields ``ORDERED``."""
    if isinstance(kind, ArrayType):
        return F.array_sort(F.array_distinct(F.transform(value, lambda item: _as_set(item, kind.elementType))))
    if isinstance(kind, StructType):
        parts = [value[f.name] if f.name in ORDERED else _as_set(value[f.name], f.dataType) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*[p.alias(f.name) for p, f in zip(parts, kind.fields, strict=True)]))
    return value


def default_endpoints(bundles: DataFrame, web: bool = False, port: int = DEFAULT_SERVICE_PORT) -> DataFrame:
    """The endpoint a bundle has when it declares none: one row per bundle.

    It serves nothing to the outside, and has a service name if access rules are enabled. For
    ``web`` bundles it takes all paths, by a rule if those are enabled, else by the URI of ``port``.
    """
    acls_on = F.col("enable_acls")
    no_uris = F.array().cast("array<string>")
    if web:
        everything = F.expr(
            "array(named_struct('family', 'http', 'http', array(named_struct('method', null, 'path', '^/', "
            "'is_regex', true, 'rewrite', null)), 'ports', null))"
        )
        services = F.when(~acls_on, F.array(F.lit(f"http://:{port}")))
        acls = F.when(acls_on, everything.cast(ACLS))
    else:
        services, acls = no_uris, F.lit(None).cast(ACLS)
    return bundles.select(
        F.col("name").alias("bundle"),
        F.lit(DEFAULT_LABEL).alias("label"),
        F.lit("http").alias("bind_protocol"),
        F.lit(0).alias("bind_port"),
        services.alias("services"),
        F.when(acls_on, F.lit(DEFAULT_LABEL)).alias("service_name"),
        acls.alias("acls"),
    )


def override_per_entity(
    base: DataFrame, override: DataFrame, defined: DataFrame, entity: str
) -> DataFrame:
    """The override of every entity that defines one, even an empty one, else its base.

    ``defined`` lists the entities that define an override, ``override`` holds its rows, if any.
    """
    owners = defined.select(entity).union(override.select(entity)).distinct()
    owners = owners.withColumnRenamed(entity, "_owner")
    kept = base.join(owners, F.col(entity).eqNullSafe(F.col("_owner")), "left_anti")
    return kept.unionByName(override.select(*base.columns))


def override_global(base: DataFrame, override: DataFrame, within: str | None = None) -> DataFrame:
    """Only overrides, for all entities, as soon as any entity has a non-empty one; else the base.

    With ``within``, a column that tells builds apart, this holds for each build by itself.
    """
    rows = override.select(*base.columns)
    if within is None:
        return base.filter(~override.limit(1).exists()).unionByName(rows)
    builds = override.select(F.col(within).alias("_build")).distinct()
    kept = base.join(builds, F.col(within).eqNullSafe(F.col("_build")), "left_anti")
    return kept.unionByName(rows)


def manual_or_derived(
    manual: DataFrame, default: DataFrame, derived: DataFrame, entity: str, label: str, fields: Sequence[str]
) -> DataFrame:
    """Manual rows of entities where they differ from the default in any way, else the derived rows.

    Two sets of rows are equal when every label is in both with equal fields. Lists are sets here,
    so neither order nor repeats count, but for the HTTP requests of a rule, which are tried in order.
    Entities are those that have manual or default rows, and those with derived rows only keep them.
    """
    keys = [entity, label]

    def compared(df: DataFrame) -> Column:
        return F.struct(*[_as_set(F.col(f), df.schema[f].dataType).alias(f) for f in fields])

    sides = manual.select(*keys, compared(manual).alias("_m"), F.lit(True).alias("_in_m"))
    other = prefixed(default.select(*keys, compared(default).alias("_d"), F.lit(True).alias("_in_d")), keys, "_d_")
    both = sides.join(other, same([(F.col(k), F.col("_d_" + k)) for k in keys]), "full")
    equal = F.coalesce(F.col("_in_m") & F.col("_in_d"), F.lit(False)) & F.col("_m").eqNullSafe(F.col("_d"))
    owner = F.when(F.col("_in_m"), F.col(entity)).otherwise(F.col("_d_" + entity))
    changed = both.groupBy(owner.alias("_owner")).agg(F.bool_or(~equal).alias("_c")).filter("_c")
    is_owner = F.col(entity).eqNullSafe(F.col("_owner"))
    columns = [*keys, *fields]
    return (
        manual.select(*columns)
        .join(changed, is_owner, "left_semi")
        .unionByName(derived.select(*columns).join(changed, is_owner, "left_anti"))
    )
