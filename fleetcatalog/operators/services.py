"""Service catalog from JSON descriptors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import path_prefix
from ..functions.fixed import (
    DEFAULT_SERVICE_PORT,
    PRESERVE_PATH,
    REMOTING_LABEL,
    REMOTING_PROTOCOL,
)
from .overrides import ACLS
from .spread import durable

# Names keep their JSON type. The rules stay JSON text here, so that patterns can be found in them at any depth.
DESCRIPTORS = "array<struct<name:variant,acls:string>>"

# A key and its text value. Within a text value of its own the quotes would be escaped.
PATTERN_KEY = r'"pathPattern"\s*:'
PATTERN = PATTERN_KEY + r'\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")'


def _parsed(json: Column) -> Column:
    # An object alone would also read as a list of one.
    return F.when(json.rlike(r"^\s*\["), F.from_json(json, DESCRIPTORS))


def _name(service: Column) -> Column:
    """The name where it is a JSON text; null for a number, a list, or any other type."""
    return F.when(F.schema_of_variant(service["name"]) == "STRING", F.try_variant_get(service["name"], "$", "string"))


def _pattern_texts(acls: Column) -> Column:
    """All patterns below ``acls``, each still a quoted JSON text."""
    return F.coalesce(F.regexp_extract_all(acls, F.lit(PATTERN), F.lit(1)), F.array().cast("array<string>"))


def _bad(json: Column) -> Column:
    parsed = _parsed(json)

    def wrong(service: Column) -> Column:
        keys = F.regexp_count(F.coalesce(service["acls"], F.lit("")), F.lit(PATTERN_KEY))
        return service.isNull() | _name(service).isNull() | (keys != F.size(_pattern_texts(service["acls"])))

    return parsed.isNull() | F.exists(parsed, wrong)


def descriptor_errors(df: DataFrame, json: str = "json") -> DataFrame:
    """Rows whose JSON is no list of objects that each have a text as name and only texts as patterns."""
    return df.filter(_bad(F.col(json)))


def parse_descriptors(df: DataFrame, keys: Sequence[str], json: str = "json", strict: bool = False) -> DataFrame:
    """One row per described service: ``(keys, service, prefixes)``.

    One leading slash of the name is dropped. ``prefixes`` are the distinct literal paths that the
    patterns anywhere below its ``acls`` begin with; patterns that begin otherwise are left out.
    What :func:`descriptor_errors` lists is left out, or fails the job if ``strict``.
    """
    if strict:
        told = F.concat(F.lit("not a list of service descriptors: "), F.coalesce(F.left(json, F.lit(200)), F.lit("null")))
        df = df.withColumn(json, F.when(_bad(F.col(json)), F.raise_error(told).cast("string")).otherwise(F.col(json)))
    named = F.transform(_parsed(F.col(json)), lambda s: F.struct(_name(s).alias("name"), s["acls"].alias("acls")))
    services = df.select(*keys, F.inline(named)).filter(F.col("name").isNotNull())
    texts = F.concat(F.lit("["), F.array_join(_pattern_texts(F.col("acls")), ","), F.lit("]"))
    found = F.transform(F.from_json(texts, "array<string>"), path_prefix)
    return services.select(
        *keys,
        F.regexp_replace("name", r"^/", "").alias("service"),
        F.array_distinct(F.filter(found, lambda p: p.isNotNull())).alias("prefixes"),
    )


def _paths(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ``(keys, service, prefix)``; a descriptor without paths gives a null prefix."""
    bare = F.array(F.lit(None).cast("string"))
    prefixes = F.when(F.size("prefixes") == 0, bare).otherwise(F.col("prefixes"))
    return parsed.select(*keys, "service", F.explode(prefixes).alias("prefix")).distinct()


def _rule(prefix: Column) -> Column:
    return F.concat(F.lit("^"), F.when(prefix == "", "/").otherwise(prefix))


def _uri(tail: Column, port: int) -> Column:
    return F.concat(F.lit(f"http://:{port}"), tail)


def service_rules(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ``(keys, service, rule)``, each rule a regex for the start of a path.

    Same-named services are one. Equal rules are kept once.
    """
    found = _paths(parsed, keys).filter(F.col("prefix").isNotNull())
    return found.select(*keys, "service", _rule(F.col("prefix")).alias("rule")).distinct()


def service_uris(
    parsed: DataFrame, keys: Sequence[str], port: int = DEFAULT_SERVICE_PORT
) -> DataFrame:
    """Distinct ``(keys, service, uri)``: one per path, and always one with the service's name."""
    paths = F.transform("prefixes", lambda p: _uri(F.concat(p, F.lit(PRESERVE_PATH)), port))
    own = _uri(F.concat(F.lit("/"), F.col("service")), port)
    uris = F.concat(paths, F.array(own))
    return parsed.select(*keys, "service", F.explode(uris).alias("uri")).distinct()


EMPTY = "array<string>"


def _endpoint_rows(headers: DataFrame, items: DataFrame, sets: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """A header row per endpoint, ``item`` null, and a row per item of it with all other fields null.

    Every descriptor set gets the remoting endpoint, in place of one of the same label.
    """
    fixed = sets.select(*keys).distinct().select(
        *keys,
        F.lit(REMOTING_LABEL).alias("label"),
        F.lit(REMOTING_PROTOCOL).alias("bind_protocol"),
        F.lit(0).alias("bind_port"),
        F.array().cast(EMPTY).alias("services"),
        F.lit(None).cast("string").alias("service_name"),
    )
    own = [
        df.withColumnRenamed("service", "label").filter(F.col("label") != REMOTING_LABEL) for df in (headers, items)
    ]
    both = own[0].unionByName(fixed).withColumn(item, F.lit(None).cast("string"))
    columns = [*keys, "label", item, "bind_protocol", "bind_port", "services", "service_name"]
    return both.unionByName(own[1], allowMissingColumns=True).select(*columns)


def acl_endpoints(descriptors: DataFrame, keys: Sequence[str], json: str = "json", strict: bool = False) -> DataFrame:
    """Endpoints with route rules: a header row per endpoint and a row per ``rule``.

    ``services`` is null, or empty if any descriptor of the service has no rules. All other fields
    depend on the name alone. The form is the same for any number of rules. The distinct paths
    are written down, so that the JSON is parsed once.
    """
    names = [*keys, "service"]
    paths = durable(_paths(parse_descriptors(descriptors, keys, json, strict), keys))
    headers = paths.groupBy(*names).agg(F.bool_or(F.col("prefix").isNull()).alias("bare")).select(
        *names,
        F.lit("http").alias("bind_protocol"),
        F.lit(0).alias("bind_port"),
        F.when(F.col("bare"), F.array().cast(EMPTY)).alias("services"),
        F.col("service").alias("service_name"),
    )
    rules = paths.filter(F.col("prefix").isNotNull()).select(*names, _rule(F.col("prefix")).alias("rule")).distinct()
    return _endpoint_rows(headers, rules, descriptors, keys, "rule")


def uri_endpoints(
    descriptors: DataFrame, keys: Sequence[str], json: str = "json", port: int = DEFAULT_SERVICE_PORT, strict: bool = False
) -> DataFrame:
    """Endpoints with service URIs: a header row per endpoint and a row per ``uri``."""
    uris = durable(service_uris(parse_descriptors(descriptors, keys, json, strict), keys, port))
    headers = uris.select(*keys, "service").distinct().select(
        *keys,
        "service",
        F.lit("http").alias("bind_protocol"),
        F.lit(0).alias("bind_port"),
        F.lit(None).cast(EMPTY).alias("services"),
        F.lit(None).cast("string").alias("service_name"),
    )
    return _endpoint_rows(headers, uris, descriptors, keys, "uri")


def declared_endpoints(rows: DataFrame, bundle: str) -> DataFrame:
    """The rows of :func:`acl_endpoints` or :func:`uri_endpoints` as declared endpoints, one row each.

    ``bundle`` is the key that names the bundle. A declared endpoint holds all its rules, so those of
    one service have to fit a row; they are a sorted set. URIs become its services.
    """
    item = "rule" if "rule" in rows.columns else "uri"
    header = F.col(item).isNull()
    of_header = lambda name: F.first(F.when(header, F.col(name)), ignorenulls=True).alias(name)
    fields = ("bind_protocol", "bind_port", "services", "service_name")
    listed = rows.groupBy(F.col(bundle).alias("bundle"), "label").agg(
        F.array_sort(F.collect_set(item)).alias("_items"), *[of_header(name) for name in fields]
    )
    some = F.size("_items") > 0
    if item == "uri":
        services, acls = F.when(some, F.col("_items")).otherwise(F.col("services")), F.lit(None).cast(ACLS)
    else:
        none = F.lit(None).cast("string")
        http = F.transform(
            "_items", lambda r: F.struct(none.alias("method"), r.alias("path"), F.lit(True).alias("is_regex"), none.alias("rewrite"))
        )
        rule = F.struct(F.lit("http").alias("family"), http.alias("http"), F.lit(None).cast("array<int>").alias("ports"))
        services, acls = F.col("services"), F.when(some, F.array(rule)).cast(ACLS)
    return listed.select("bundle", "label", "bind_protocol", "bind_port", services.alias("services"), "service_name", acls.alias("acls"))
