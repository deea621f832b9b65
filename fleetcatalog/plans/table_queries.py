"""Every job on the given tables: each query reads its tables whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    artifact_name,
    binary_bytes,
    compat_version,
    config_present,
    decimal_bytes,
    env_name,
    flag_args,
    is_pair,
    list_text,
    major_minor_tag,
    name_hex,
    name_or_path,
    package_name,
    pair_key,
    pair_request,
    pair_value,
    round_up_kib,
    tuple_request,
    whole_seconds,
)
from ..operators import contents, fold, history, install, manifest, matching, overlay
from ..operators import overrides, placement, ports, routes, services, validation
from ..operators.overrides import ACLS
from ..operators.spread import previous_value
from ..store import durable, shared_folder
from ..sources import documents, reports
from . import distribution, local_run

Query = Callable[[SparkSession, str], DataFrame]

def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages")
    return pages.select(
        "page_id",
        "url",
        F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"),
        F.try_parse_url("url", F.lit("HOST")).alias("host"),
        F.try_parse_url("url", F.lit("PATH")).alias("path"),
    )


def _descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """A descriptor per page: its host as service, its path quoted, its first folder quoted, its path bare.

    Pages of even number also have the root and, for some, the bare slashes of an empty prefix. The JSON of
    every third begins with white space.
    """
    def quoted(text: Column) -> Column:
        return F.concat(F.lit("\\Q"), text, F.lit("\\E"))

    patterns = [
        quoted(F.col("path")),
        F.concat(quoted(F.regexp_extract("path", "^(/[^/]+/)", 1)), F.lit("([^/]+)")),
        F.col("path"),
        F.when(F.col("page_id") % 2 == 0, quoted(F.lit("/"))).otherwise(F.col("path")),
        F.when(F.col("page_id") % 4 == 0, quoted(F.lit("//"))).otherwise(F.col("path")),
    ]
    acls = F.array(*[F.struct(p.alias("pathPattern")) for p in patterns])
    described = F.array(F.struct(F.concat(F.lit("/"), "host").alias("name"), acls.alias("acls")))
    return _paths(spark, folder).select(
        F.col("scheme").alias("descriptor_set"),
        F.col("page_id").alias("seq"),
        F.concat(F.when(F.col("page_id") % 3 == 0, "\n\t ").otherwise(""), F.to_json(described)).alias("json"),
    )


def _plain_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """A descriptor per page that quotes its path; hosts of some lengths have no rules."""
    pattern = F.concat(F.lit("\\Q"), "path", F.lit("\\E"))
    rules = F.when(F.length("host") % 5 == 0, F.array().cast("array<struct<pathPattern:string>>")).otherwise(
        F.array(F.struct(pattern.alias("pathPattern")))
    )
    described = F.array(F.struct(F.col("host").alias("name"), rules.alias("acls")))
    return _paths(spark, folder).select(F.col("scheme").alias("descriptor_set"), F.to_json(described).alias("json"))


def service_catalog(spark: SparkSession, folder: str) -> DataFrame:
    parsed = services.parse_descriptors(_descriptors(spark, folder), ["descriptor_set"])
    return services.service_rules(parsed, ["descriptor_set"])


def service_uris(spark: SparkSession, folder: str) -> DataFrame:
    parsed = services.parse_descriptors(_descriptors(spark, folder), ["descriptor_set"])
    return services.service_uris(parsed, ["descriptor_set"])


def service_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    endpoints = services.acl_endpoints(_descriptors(spark, folder), ["descriptor_set"])
    return endpoints.withColumn("services", F.array_join("services", ","))


def service_uri_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    endpoints = services.uri_endpoints(_descriptors(spark, folder), ["descriptor_set"])
    return endpoints.select("descriptor_set", "label", "uri", "bind_protocol", F.array_join("services", ",").alias("services"))


def descriptor_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptors of pages, some without name, with a number as pattern or cut off, and texts of documents."""
    texts = _read(spark, folder, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("json"))
    kind, json = F.col("seq") % 10, F.col("json")
    spoilt = (
        F.when(kind == 1, F.regexp_replace(json, '"name"', '"title"'))
        .when(kind == 2, F.regexp_replace(json, r'"pathPattern":"[^"]*"', '"pathPattern":5'))
        .when(kind == 3, F.left(json, F.length(json) - 1))
        .otherwise(json)
    )
    described = _descriptors(spark, folder).select("seq", spoilt.alias("json"))
    both = described.withColumn("origin", F.lit("pages")).union(texts.withColumn("origin", F.lit("documents")))
    return services.descriptor_errors(both).select("origin", "seq")


def descriptor_types(spark: SparkSession, folder: str) -> DataFrame:
    """Bad descriptors among those of pages, with a value of every JSON type as name, and as pattern at some depth."""
    values = F.array(*[F.lit(v) for v in ('"a"', "7", "1.5", "true", "null", '["a"]', '{"a":"b"}', '"7"', '""', r'"\u0061\"b"')])
    pages = _paths(spark, folder).select("page_id", F.get(values, F.col("page_id") % 10).alias("v"), F.get(values, F.floor(F.col("page_id") / 10) % 10).alias("w"), "path")
    acls = F.concat(F.lit('[{"pathPattern":'), F.to_json(F.struct("path")), F.lit('},{"deeper":[{"pathPattern":'), "w", F.lit("}]}]"))
    plain = F.concat(F.lit('[{"other":[{"pathPattern":'), "w", F.lit('}],"pathPattern":"x"}]'))
    json = F.concat(F.lit('[{"name":'), "v", F.lit(',"acls":'), F.when(F.col("page_id") % 3 == 0, acls).otherwise(plain), F.lit("}]"))
    return services.descriptor_errors(pages.select("page_id", json.alias("json"))).select("page_id")


def content_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return contents.content_catalog(_read(spark, folder, "documents"), "doc_id", "text")


def content_names(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents").withColumn("name", F.concat("source", F.lit(".txt")))
    return contents.content_names(documents, "doc_id", "text", "name")


def incremental_load(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as a load onto a catalog that holds the labelled ones."""
    documents = _read(spark, folder, "documents")
    loaded = documents.join(_read(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    catalog = loaded.select(contents.digest(F.col("text")).alias("digest"))
    return contents.new_contents(documents, catalog, "doc_id", "text")


def catalog_load(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents, then all, loaded into a catalog in buckets; the second load twice."""
    documents = _read(spark, folder, "documents")
    labelled = documents.join(_read(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    table = f"catalog_{uuid.uuid4().hex}"
    contents.create_catalog(spark, table, f"{shared_folder(spark)}/{table}", 8)
    contents.load_catalog(labelled, table, "doc_id", "text", "labelled")
    contents.load_catalog(documents, table, "doc_id", "text", "all")
    return contents.load_catalog(documents, table, "doc_id", "text", "all")


def path_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Each page path as a plain rule and as three regexes: prefix, whole path, and one with a double slash."""
    def form(name: str, path: Column, is_regex: bool) -> Column:
        return F.struct(F.lit(name).alias("form"), path.alias("path"), F.lit(is_regex).alias("is_regex"))

    path = F.col("path")
    forms = F.array(
        form("plain", path, False),
        form("prefix", F.concat(F.lit("^"), path), True),
        form("whole", F.concat(F.lit("^"), path, F.lit("$")), True),
        form("double", F.concat(F.lit("^/"), path), True),
    )
    rules = _paths(spark, folder).select("page_id", F.inline(forms))
    return routes.typed_rules(rules).drop("path", "is_regex")


def pair_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Two-text rules of pages: ``("GET", path)`` for https, ``(path, host)`` for http."""
    first = F.when(F.col("scheme") == "https", F.lit("GET")).otherwise(F.col("path"))
    second = F.when(F.col("scheme") == "https", F.col("path")).otherwise(F.col("host"))
    return _paths(spark, folder).select("page_id", pair_request(first, second).alias("r")).select(
        "page_id", "r.method", "r.path", "r.rewrite"
    )


def tuple_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of pages in each form that one, two or three texts can take, with and without a regex."""
    path, host, regex = F.col("path"), F.col("host"), F.concat(F.lit("^"), "path")
    method = F.when(F.col("scheme") == "https", "GET").otherwise("PUT")

    def form(name: str, regex_at: int | None, *texts: Column) -> Column:
        return F.struct(F.lit(name).alias("form"), F.array(*texts).alias("texts"), F.lit(regex_at).cast("int").alias("at"))

    forms = F.array(
        form("path", None, path), form("regex", 0, regex), form("method path", None, method, path), form("path rewrite", None, path, host),
        form("method regex", 1, method, regex), form("regex rewrite", 0, regex, host), form("three", None, method, path, host), form("three regex", 1, method, regex, host),
    )
    rows = _paths(spark, folder).select("page_id", F.inline(forms))
    return rows.select("page_id", "form", F.inline(F.array(tuple_request(F.col("texts"), F.col("at")))))


def _customer_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """An endpoint per customer with three HTTP rules, two of three TCP ports and a UDP port."""
    return _read(spark, folder, "customer").select(
        F.col("c_name").alias("bundle"),
        F.col("c_mktsegment").alias("label"),
        F.expr(
            f"""CAST(array(
              named_struct('family', 'http', 'http', array(
                named_struct('method', 'GET', 'path', concat('/c/', c_custkey), 'is_regex', false, 'rewrite', null),
                named_struct('method', null, 'path', concat('^/n/', c_nationkey), 'is_regex', true, 'rewrite', '/all'),
                named_struct('method', CASE WHEN c_acctbal < 0 THEN 'PATCH' ELSE 'PUT' END,
                             'path', concat('/[0-9]+/', c_custkey), 'is_regex', true, 'rewrite', null)), 'ports', null),
              named_struct('family', 'tcp', 'http', null, 'ports', array(9000 + c_nationkey, 9000, 9000 + c_nationkey)),
              named_struct('family', 'udp', 'http', null, 'ports', array(19000 + c_nationkey))) AS {ACLS})"""
        ).alias("acls"),
    )


def route_rules(spark: SparkSession, folder: str) -> DataFrame:
    return routes.route_rules(_customer_endpoints(spark, folder))


def _listing(spark: SparkSession, folder: str, family: str) -> DataFrame:
    rules = routes.route_rules(_customer_endpoints(spark, folder))
    return routes.acl_listing(rules, family)


def acl_listing(spark: SparkSession, folder: str) -> DataFrame:
    return _listing(spark, folder, "tcp").select("bundle", "label", "family", "port")


def acl_listing_udp(spark: SparkSession, folder: str) -> DataFrame:
    return _listing(spark, folder, "udp").select("bundle", "label", "family", "port")


def acl_listing_http(spark: SparkSession, folder: str) -> DataFrame:
    return _listing(spark, folder, "http").select("bundle", "label", "method", "kind", "value", "rewrite", "error")


def _part_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "part").select(
        _text("p_partkey").alias("name"),
        F.when(F.col("p_type") == "STANDARD", "1.1").otherwise("2.0").alias("target_version"),
        (F.col("p_retailprice") < 950).alias("enable_acls"),
        binary_bytes(F.col("p_size"), "MiB").alias("memory"),
        binary_bytes(F.lit(24), "MiB").alias("min_memory"),
    )


def _line_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """An endpoint per line item. Returned items declare no services, those of high tax and discount rules."""
    return _read(spark, folder, "lineitem").select(
        _text("l_partkey").alias("bundle"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("label"),
        F.when(F.col("l_returnflag") != "R", F.array().cast("array<string>")).alias("services"),
        F.when((F.col("l_tax") >= 0.08) & (F.col("l_discount") >= 0.1), F.array().cast(ACLS)).alias("acls"),
    )


def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return validation.violations(_part_bundles(spark, folder), _line_endpoints(spark, folder))


def valid_bundles(spark: SparkSession, folder: str) -> DataFrame:
    bundles = _part_bundles(spark, folder)
    report = validation.violations(bundles, _line_endpoints(spark, folder))
    return validation.valid_bundles(bundles, report).select("name")


def _customer_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of customers, each of which delegates to its nation and that to its region."""
    customer, nation, region = [_read(spark, folder, t) for t in ("customer", "nation", "region")]

    def scope(letter: str, key: str) -> Column:
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    scopes = (
        customer.select(scope("c", "c_custkey").alias("scope"), scope("n", "c_nationkey").alias("parent"), F.lit(True).alias("is_config"))
        .union(nation.select(scope("n", "n_nationkey"), scope("r", "n_regionkey"), F.lit(True)))
        .union(region.select(scope("r", "r_regionkey"), F.lit(None).cast("string"), F.lit(False)))
    )

    def listed(column: str) -> Column:
        return F.to_json(F.array(column))

    def settings(df: DataFrame, at: Column, values: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
        return df.select(at.alias("scope"), F.inline(pairs)).filter(F.col("value").isNotNull())

    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    defined = (
        settings(region, scope("r", "r_regionkey"), {"name": F.lower("r_name"), "nrOfCpus": F.lit(1), "memory": F.lit(64), "roles": listed("r_name")})
        .union(settings(nation, scope("n", "n_nationkey"), {"memory": F.when(F.col("n_regionkey") < 3, F.col("n_nationkey") + 100)}))
        .union(
            settings(
                customer,
                scope("c", "c_custkey"),
                {
                    "nrOfCpus": F.when(balance < 0, F.lit(2)),
                    "roles": F.when(segment == "BUILDING", listed("c_mktsegment")),
                    "checks": F.when(segment == "MACHINERY", listed("c_name")),
                },
            )
        )
    )
    return overlay.resolve_settings(defined, scopes)


def overlay_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_settings(spark, folder)


def overlay_delta(spark: SparkSession, folder: str) -> DataFrame:
    return overlay.overlay_delta(_customer_settings(spark, folder), full=False)


def overlay_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scopes, each of which delegates to the one before of its user; some set a status, a level or a place."""
    events = _read(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value", F.col("event_id").cast("string").alias("scope"))
    scopes = previous_value(events, ["user_id"], ["ts", "event_id"], "scope", "parent")
    scopes = scopes.select("scope", "parent", F.col("parent").isNotNull().alias("is_config"))
    value = F.col("value").cast("string")
    pairs = {"status": F.when(F.col("event_type") == "error", value), "level": F.when(F.col("value") > 20, value), "place": F.when(F.col("value") < 1, F.col("event_type"))}
    each = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    defined = events.select("scope", F.inline(each)).filter(F.col("value").isNotNull())
    return overlay.resolve_settings(defined, scopes)


def settings_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Full manifests and deltas, side by side."""
    resolved = durable(_customer_settings(spark, folder))
    full = manifest.settings_manifest(resolved, full=True).withColumn("mode", F.lit("full"))
    return full.unionByName(manifest.settings_manifest(resolved, full=False).withColumn("mode", F.lit("delta")))


def default_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Default endpoints of parts as bundles, plain and for the web, as one JSON text each."""
    version = F.when(F.col("p_type") == "STANDARD", "1.1").when(F.col("p_type") == "PROMO", "2.0")
    bundles = manifest.version_defaults(
        _read(spark, folder, "part").select(
            _text("p_partkey").alias("name"),
            version.alias("target_version"),
            F.when(F.col("p_size") < 5, F.lit(False)).alias("enable_acls"),
        )
    )
    kinds = [
        overrides.default_endpoints(bundles, web).withColumn("kind", F.lit(kind))
        for kind, web in (("plain", False), ("web", True))
    ]
    document = manifest.endpoint_document(F.struct(*manifest.ENDPOINT_FIELDS))
    return kinds[0].unionByName(kinds[1]).select("bundle", "label", "kind", F.to_json(document).alias("endpoint"))


def _base_and_override(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers per nation; nations of two regions define an override: their customers."""
    base = _read(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("entity"), F.col("s_name").alias("label"), (F.col("s_suppkey") + 9000).alias("port")
    )
    defined = _read(spark, folder, "nation").filter(F.col("n_regionkey") < 2).select(F.col("n_nationkey").alias("entity"))
    override = (
        _read(spark, folder, "customer")
        .select(F.col("c_nationkey").alias("entity"), F.col("c_name").alias("label"), (F.col("c_custkey") + 8000).alias("port"))
        .join(defined, "entity", "left_semi")
    )
    return base, override, defined


def override_per_entity(spark: SparkSession, folder: str) -> DataFrame:
    return overrides.override_per_entity(*_base_and_override(spark, folder), "entity")


def override_global(spark: SparkSession, folder: str) -> DataFrame:
    """Once with overrides, once with none."""
    base, override, _ = _base_and_override(spark, folder)
    none = override.filter(F.col("port") < 0)
    some = overrides.override_global(base, override).withColumn("case", F.lit("some"))
    return some.unionByName(overrides.override_global(base, none).withColumn("case", F.lit("none")))


def manual_or_derived(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose manual endpoint is the default get one per order instead. Names in another order, or twice, are no change."""
    customer = _read(spark, folder, "customer")
    entity, name = F.col("c_custkey").alias("entity"), F.col("c_name")
    default = customer.select(
        entity, F.lit("web").alias("label"), F.lit(0).cast("long").alias("port"), F.array(F.lit("a"), name).alias("services")
    )
    manual = customer.select(
        entity,
        F.lit("web").alias("label"),
        F.when(F.col("c_acctbal") < 0, F.col("c_custkey")).otherwise(0).alias("port"),
        F.array(name, F.when(F.col("c_nationkey") == 0, "b").otherwise("a"), name).alias("services"),
    )
    derived = _read(spark, folder, "orders").select(
        F.col("o_custkey").alias("entity"),
        _text("o_orderkey").alias("label"),
        F.col("o_orderkey").alias("port"),
        F.array("o_orderstatus").alias("services"),
    )
    found = overrides.manual_or_derived(manual, default, derived, "entity", "label", ["port", "services"])
    return found.withColumn("services", F.array_join("services", ","))


def _uris(spark: SparkSession, folder: str) -> DataFrame:
    """URIs of suppliers with and without host and port, some unreadable, and of all pages."""
    key = _text("s_suppkey")
    forms = F.array(
        F.concat(F.lit("http://:"), (F.col("s_suppkey") + 9000).cast("string"), F.lit("/"), key),
        F.concat(F.lit("tcp://host-"), key, F.lit(":"), (F.col("s_nationkey") + 7000).cast("string")),
        F.concat(F.lit("http://host-"), key, F.lit("/x")),
        F.concat(F.lit("http://:port"), key),
    )
    own = _read(spark, folder, "supplier").select(F.explode(forms).alias("uri"))
    return own.union(_read(spark, folder, "pages").select("url"))


def uri_ports(spark: SparkSession, folder: str) -> DataFrame:
    return ports.uri_ports(_uris(spark, folder), "uri")


def exposed_ports(spark: SparkSession, folder: str) -> DataFrame:
    given = _read(spark, folder, "part").select(F.col("p_size").alias("port"))
    return ports.exposed_ports(_uris(spark, folder), "uri", given)


EVENT_FIELDS = {
    "log_level": fold.LAST,
    "args": fold.APPEND,
    "ports": fold.ADD,
    "envs": fold.PUT,
    "no_default_features": fold.SET,
}


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))


def _event_args(spark: SparkSession, folder: str) -> DataFrame:
    """Events as arguments of their user; a sign-up gives an environment pair without a value, which is left out."""
    kind, k = F.col("event_type"), F.col("k")

    def arg(name: Column, value: Column) -> Column:
        return F.struct(name.alias("field"), value.cast("string").alias("value"))

    args = F.array(
        arg(F.lit("log_level"), kind),
        arg(F.lit("args"), F.concat(kind, F.lit("-"), k)),
        arg(F.lit("ports"), F.floor("value").cast("int")),
        arg(F.lit("envs"), F.concat(kind, F.lit("="), F.when(kind == "signup", "").otherwise(k))),
        arg(F.when(kind == "error", "no_default_features"), F.lit(None)),
    )
    given = _events(spark, folder).select("user_id", "ts", "event_id", F.inline(args))
    return given.filter(F.col("field").isNotNull())


def settings_fold(spark: SparkSession, folder: str) -> DataFrame:
    return fold.fold_settings(_event_args(spark, folder), "user_id", ["ts", "event_id"], EVENT_FIELDS)


def settings_record(spark: SparkSession, folder: str) -> DataFrame:
    folded = settings_fold(spark, folder)
    records = fold.fold_records(folded, "user_id", EVENT_FIELDS)
    return records.select("user_id", "field", "pos", "key", "value", "log_level", "no_default_features")


def install_plan(spark: SparkSession, folder: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    projects = _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("bundles/"), "c_name", F.lit(".zip")).alias("bundle_file"),
        (F.col("c_acctbal") >= 0).alias("has_bundle"),
        (segment != "MACHINERY").alias("has_configuration"),
        F.when(segment == "BUILDING", "x").when(segment == "FURNITURE", "").alias("config_text"),
        (F.col("c_nationkey") < 5).alias("config_dir_exists"),
        F.concat(F.lit("configs/"), "c_name", F.lit(".zip")).alias("config_file"),
    )
    fixed = _read(spark, folder, "region").select(
        F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.lower("r_name").alias("bundle_name")
    )
    return install.install_plan(projects, fixed)


def report_names(spark: SparkSession, folder: str) -> DataFrame:
    return reports.report_names(_read(spark, folder, "documents"), "doc_id", "text")


def report_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as reports of a header and up to fifty lines, whose ends differ by report."""
    line = F.concat_ws(" ", "c_custkey", "c_name", F.lit("v1"), "c_nationkey", F.length("c_mktsegment"), "c_mktsegment")
    report = F.floor(F.col("c_custkey") / 50).alias("report")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"])
    told = _read(spark, folder, "customer").groupBy(report).agg(lines.alias("lines"))
    ends = F.when(F.col("report") % 3 == 0, "\r\n").when(F.col("report") % 3 == 1, "\r").otherwise("\n")
    joined = F.array_join(F.concat(F.array(F.lit("ID NAME")), "lines"), "\x00")
    return reports.report_counts(told.select("report", F.replace(joined, F.lit("\x00"), ends).alias("text")), "report", "text")


def manifest_emit(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as bundles, their line items as endpoints."""
    orders = _read(spark, folder, "orders")
    key = F.concat(F.lit("order-"), _text("o_orderkey"))
    checked = F.col("o_orderstatus") == "F"
    bundles = orders.select(
        key.alias("name"),
        F.concat_ws(".", F.length("o_orderpriority"), _text("o_custkey")).alias("version"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.lit(None).cast("string").alias("system"),
        F.lit(None).cast("string").alias("system_version"),
        F.lit(None).cast("string").alias("annotations"),
        F.lit(0.5).alias("nr_of_cpus"),
        binary_bytes(F.length("o_orderpriority"), "MiB").alias("memory"),
        F.lit(None).cast("long").alias("min_memory"),
        F.lit(None).cast("long").alias("disk_space"),
        F.array("o_orderstatus").alias("roles"),
        F.col("o_custkey").alias("check_delay_ms"),
        F.when(checked, F.array(F.concat(F.lit("$HOST?"), _text("o_custkey")))).alias("checks"),
        F.col("o_orderpriority").alias("description"),
        F.array(F.lit("bin/run")).alias("start_command"),
    )
    endpoints = _read(spark, folder, "lineitem").select(
        F.concat(F.lit("order-"), _text("l_orderkey")).alias("bundle"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date")).alias("label"),
        F.lit("http").alias("bind_protocol"),
        F.lit(0).alias("bind_port"),
        F.when(F.col("l_returnflag") != "R", F.array(F.concat(F.lit("http://:"), _text("l_suppkey")))).alias("services"),
        F.when(F.col("l_linestatus") == "O", F.lit("svc")).alias("service_name"),
        F.when(
            F.col("l_returnflag") == "R",
            F.expr(
                f"""CAST(array(
                  named_struct('family', 'http', 'http', array(
                    named_struct('method', 'GET', 'path', concat('^/p/', l_partkey), 'is_regex', true, 'rewrite', null)),
                    'ports', null),
                  named_struct('family', 'tcp', 'http', null, 'ports', array(l_linenumber))) AS {ACLS})"""
            ),
        ).alias("acls"),
    )
    complete = manifest.resource_normalize(manifest.bundle_names(bundles))
    return manifest.manifest_emit(complete, endpoints)


def manifest_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the manifests of orders."""
    return manifest.manifest_digests(durable(manifest_emit(spark, folder), "zstd"))


def _supplier_manifests(spark: SparkSession, folder: str, moved: bool = False) -> DataFrame:
    """Suppliers as bundles, their line items as endpoints; in the moved version some have other ports, labels, or are gone."""
    line, gone = _read(spark, folder, "lineitem"), F.col("l_quantity") == 7
    if moved:
        line = line.filter(~gone)
    port = F.col("l_linenumber") + F.when(F.lit(moved) & (F.col("l_partkey") % 19 == 3), 1000).otherwise(0)
    label = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.when(F.lit(moved) & (F.col("l_orderkey") % 101 == 5), F.lit("new")))
    endpoints = line.select(
        _text("l_suppkey").alias("bundle"), label.alias("label"), F.lit("tcp").alias("bind_protocol"), port.cast("int").alias("bind_port"),
        F.array().cast("array<string>").alias("services"), F.lit(None).cast("string").alias("service_name"), F.lit(None).cast(ACLS).alias("acls"),
    )
    none = F.lit(None)
    bundles = _read(spark, folder, "supplier").select(
        _text("s_suppkey").alias("name"), F.lit("1.0").alias("version"), none.cast("array<string>").alias("tags"), none.cast("string").alias("system"),
        none.cast("string").alias("system_version"), none.cast("string").alias("annotations"), none.cast("double").alias("nr_of_cpus"), none.cast("long").alias("memory"),
        none.cast("long").alias("min_memory"), none.cast("long").alias("disk_space"), none.cast("array<string>").alias("roles"), none.cast("long").alias("check_delay_ms"),
        none.cast("array<string>").alias("checks"), F.col("s_name").alias("description"), F.array(F.lit("bin/run")).alias("start_command"),
    )
    return durable(manifest.manifest_emit(manifest.resource_normalize(manifest.bundle_names(bundles)), endpoints), "zstd")


def manifest_files(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of suppliers written as a file each, and the ports of their endpoints read from the files again."""
    manifests = _supplier_manifests(spark, folder)
    artifacts = manifest.manifest_digests(manifests).select("bundle", F.concat("bundle", F.lit("-"), "digest", F.lit(".json")).alias("artifact"))
    path = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    documents.write_documents(manifests, artifacts, path)
    port = F.get_json_object("document", "$['bind-port']").cast("int")
    return documents.read_documents(spark, path).select("bundle", "label", port.alias("port"))


def manifest_tree(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest_tree(_supplier_manifests(spark, folder))


def manifest_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items whose endpoints differ between two versions of the manifests of suppliers."""
    changes = manifest.manifest_changes(_supplier_manifests(spark, folder), _supplier_manifests(spark, folder, moved=True))
    return changes.select("bundle", "label", "change")


def detected_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """From descriptors of pages to manifests: settings, detected endpoints, checks, documents and digests.

    A bundle per scheme of pages.
    """
    detected = services.declared_endpoints(services.acl_endpoints(_plain_descriptors(spark, folder), ["descriptor_set"]), "descriptor_set")
    named = _paths(spark, folder).select(F.col("scheme").alias("name")).distinct()
    none = F.lit(None)
    bundles = named.select(
        "name", F.concat(F.lit("s-"), "name").alias("scope"), F.lit("1.2").alias("version"), none.cast("array<string>").alias("tags"),
        none.cast("string").alias("system"), none.cast("string").alias("system_version"), none.cast("string").alias("target_version"),
        none.cast("boolean").alias("enable_acls"), none.cast("double").alias("nr_of_cpus"), none.cast("long").alias("memory"),
        none.cast("long").alias("min_memory"), none.cast("long").alias("disk_space"), none.cast("array<string>").alias("roles"),
        none.cast("string").alias("annotations"), none.cast("long").alias("check_delay_ms"), none.cast("array<string>").alias("checks"),
        F.col("name").alias("description"), F.array(F.lit("bin/run")).alias("start_command"),
    )
    root = spark.createDataFrame([("build", None, False)], "scope string, parent string, is_config boolean")
    scopes = bundles.select("scope", F.lit("build").alias("parent"), F.lit(True).alias("is_config")).unionByName(root)
    pages = _read(spark, folder, "pages").agg(F.count(F.lit(1)).alias("n"))
    of_build = F.array(
        F.struct(F.lit("memory").alias("key"), (F.col("n") + 402653184).cast("string").alias("value")),
        F.struct(F.lit("roles").alias("key"), F.to_json(F.array(F.lit("web"), F.lit("pages"))).alias("value")),
    )
    settings = pages.select(F.lit("build").alias("scope"), F.inline(of_build))
    # Written down, so that the one scope name does not turn joins into products.
    complete = distribution.apply_settings(bundles, durable(settings), durable(scopes)).drop("scope")
    derived = overrides.manual_or_derived(detected.limit(0), detected.limit(0), detected, "bundle", "label", list(manifest.ENDPOINT_FIELDS))
    none_defined = detected.select("bundle").limit(0)
    made = distribution.distribute(complete, derived, derived.limit(0), none_defined)
    return made.manifests.join(made.artifacts.select("bundle", "artifact"), "bundle")


def run_settings(spark: SparkSession, folder: str) -> DataFrame:
    """A run per user: its events as arguments and endpoints; the views of users in error are overrides."""
    user = _text("user_id").alias("entity")
    events = _events(spark, folder)
    uri = F.concat(F.lit("http://:"), (F.floor("value") + 1000).cast("string"))
    failed = events.filter(F.col("event_type") == "error").select(user).distinct()
    args = events.select(
        user, F.col("event_id").alias("seq"), F.lit("ports").alias("field"), F.floor("value").cast("string").alias("value")
    )
    endpoints = events.select("event_type", user, F.array(uri).alias("services"))
    override = endpoints.filter(F.col("event_type") == "view").drop("event_type").join(failed, "entity", "left_semi")
    return local_run.run_settings(args, endpoints.drop("event_type"), override).select("entity", "field", "key")


def resource_units(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    units = [decimal_bytes(size, u).alias(u.lower()) for u in ("KB", "MB", "GB", "TB")]
    units += [binary_bytes(size, u).alias(u.lower()) for u in ("KiB", "MiB", "GiB", "TiB")]
    return _read(spark, folder, "part").select(
        "p_partkey", *units, round_up_kib(cents).alias("rounded"), whole_seconds(cents * size - 90000).alias("seconds")
    )


def resource_normalize(spark: SparkSession, folder: str) -> DataFrame:
    small = F.col("p_size") < 10
    bundles = _read(spark, folder, "part").select(
        _text("p_partkey").alias("name"),
        F.when(small, F.col("p_size") / 4).alias("nr_of_cpus"),
        F.when(~small, binary_bytes(F.col("p_size"), "MiB")).alias("memory"),
        F.lit(None).cast("long").alias("min_memory"),
        F.when(F.col("p_type") == "PROMO", decimal_bytes(F.col("p_size"), "MB")).alias("disk_space"),
        F.when(F.col("p_type") == "LARGE", F.array("p_brand")).alias("roles"),
        F.when(small, F.col("p_partkey")).alias("check_delay_ms"),
        F.when(small, F.col("p_partkey")).alias("heap"),
    )
    return manifest.resource_normalize(bundles).withColumn("roles", F.array_join("roles", ","))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return _paths(spark, folder).select(
        F.col("page_id").alias("request_id"),
        "path",
        F.when(F.col("scheme") == "https", "GET").otherwise("POST").alias("method"),
    )


def _page_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of all page paths as plain ones for GET, of their first folders as prefixes and regexes, and the root."""
    path = F.col("path")
    first = F.regexp_extract("path", "^(/[^/]+)/", 1)

    def rule(position: int, kind: str, value: Column, method: str | None, rewrite: str | None) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
            F.lit(method).cast("string").alias("method"),
            F.lit(rewrite).cast("string").alias("rewrite"),
        )

    forms = F.array(
        rule(1, "path", path, "GET", None),
        rule(2, "path-regex", F.concat(F.lit("^"), first, F.lit("/[0-9]*5")), None, "/five"),
        rule(3, "path-beg", first, None, "/all"),
        rule(3, "path-beg", F.lit("/"), "POST", None),
        rule(4, "path-regex", F.concat(F.lit("/(xx|"), F.substr(first, F.lit(2)), F.lit(")/1")), None, None),
    )
    rules = _paths(spark, folder).filter(first != "").select(F.inline(forms)).distinct()
    return rules.withColumn("rule_id", F.concat_ws(" ", "kind", "value"))


def route_match(spark: SparkSession, folder: str) -> DataFrame:
    return matching.route_match(_requests(spark, folder), _page_rules(spark, folder))


def route_matches(spark: SparkSession, folder: str) -> DataFrame:
    return matching.route_matches(_requests(spark, folder), _page_rules(spark, folder))


def regex_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as requests, with segment, name and nation in the path, and parts as regexes without a plain beginning.

    A part's key is looked for at the end of a name, its size as nation, its type in a segment or beside its
    brand. Some kinds of regex have nothing that a match must contain.
    """
    customer, part = _read(spark, folder, "customer"), _read(spark, folder, "part")
    key, size, kind = _text("p_partkey"), _text("p_size"), F.left("p_type", F.lit(3))
    forms = F.array(
        F.concat(F.lit(r"(/[a-z]+)+/[A-Z]+/.*[#-]0*"), key, F.lit("/[0-9]+$")),
        F.concat(F.lit(".*0/"), size, F.lit("/?$")),
        F.concat(F.lit(".*/[A-Z]*"), kind, F.lit("|.*"), kind, F.lit("[A-Z]+/|/(st|b)ore/"), F.lower("p_brand")),
        F.concat(F.lit(r"/\w+/[A-Z]*[A-M]{2}/.*"), size, F.lit("$")),
    )
    rules = part.select(F.explode(forms).alias("value")).distinct().select(
        F.col("value").alias("rule_id"), F.lit(1).alias("position"), F.lit("path-regex").alias("kind"), "value",
        F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("rewrite"),
    )
    path = F.concat_ws("/", F.lit(""), F.lit("store"), "c_mktsegment", "c_name", "c_nationkey")
    requests = customer.select(F.col("c_custkey").alias("request_id"), path.alias("path"), F.lit("GET").alias("method"))
    return matching.route_matches(requests, rules)


def port_match(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests for the port of their type and value, to the TCP and UDP rules of customers."""
    rules = routes.route_rules(_customer_endpoints(spark, folder)).select(
        F.concat_ws("/", "bundle", "family", "port").alias("rule_id"), "kind", "family", "port"
    )
    requests = _read(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "click", "tcp").otherwise("udp").alias("family"),
        (F.floor("value") + 9000).cast("int").alias("port"),
    )
    return matching.port_match(requests, rules)


def name_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Beginnings of all customer names, with and without their segment as tag, and names that are not known."""
    customer = _read(spark, folder, "customer")
    names = customer.select(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags"))
    short = F.left("c_name", F.length("c_mktsegment") + 8)
    forms = F.array(short, F.concat(short, F.lit(":"), "c_mktsegment"), F.concat(F.lit("No "), "c_name"))
    return matching.name_resolve(customer.select(F.explode(forms).alias("query")), names)


def _placement(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as bundles by size and price, suppliers as nodes by nation and balance."""
    bundles = _read(spark, folder, "part").select(
        "p_partkey",
        F.col("p_size").cast("double").alias("cpus"),
        F.col("p_retailprice").alias("memory"),
        F.when(F.col("p_type") != "SMALL", F.array("p_type", F.lit("ANY"))).alias("roles"),
    )
    kinds = F.when(F.col("s_nationkey") < 8, F.array(F.lit("PROMO"), F.lit("ANY"))).when(
        F.col("s_nationkey") < 16, F.array(F.lit("LARGE"), F.lit("PROMO"))
    )
    nodes = _read(spark, folder, "supplier").select(
        (F.col("s_nationkey") * 2.5).alias("cpus"), (F.col("s_acctbal") / 8).alias("memory"), kinds.alias("roles")
    )
    return placement.placement_candidates(bundles, nodes, "p_partkey", ["cpus", "memory"])


def placement_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _placement(spark, folder)


def placement_by_disk(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as bundles by size, price and key, line items as nodes by quantity, price and order: three amounts and roles."""
    part, line = _read(spark, folder, "part"), _read(spark, folder, "lineitem")
    bundles = part.select(
        "p_partkey",
        F.col("p_size").cast("double").alias("cpus"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("memory"),
        (F.col("p_partkey") % 997 * 50).alias("disk"),
        F.when(F.col("p_type") == "PROMO", F.array(F.lit("R"), F.lit("A"))).when(F.col("p_type") == "LARGE", F.array(F.lit("N"))).alias("roles"),
    )
    nodes = line.groupBy("l_suppkey", "l_returnflag").agg(
        F.max("l_quantity").alias("cpus"), F.round(F.max("l_extendedprice") * 2).cast("long").alias("memory"), F.max("l_orderkey").alias("disk")
    )
    return placement.placement_candidates(bundles, nodes.withColumn("roles", F.array("l_returnflag")), "p_partkey", ["cpus", "memory", "disk"])


def unplaceable(spark: SparkSession, folder: str) -> DataFrame:
    return placement.unplaceable(_placement(spark, folder)).select("p_partkey")


def compat_history(spark: SparkSession, folder: str) -> DataFrame:
    versions = F.concat_ws(".", F.left("o_orderpriority", F.lit(1)), _text("o_orderkey"))
    orders = _read(spark, folder, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", compat_version(versions).alias("compat")
    )
    return history.compat_history(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "compat")


def event_tail(spark: SparkSession, folder: str) -> DataFrame:
    tail = history.event_tail(_read(spark, folder, "events"), "user_id", "ts", "event_id", 3)
    ts = F.col("ts")
    return tail.select(
        "user_id",
        "event_id",
        "event_type",
        "rank",
        history.event_time(ts).alias("time"),
        history.event_time(ts, date=True).alias("date_time"),
        history.event_time(ts, date=True, utc=False, zone="Asia/Tokyo").alias("zoned"),
    )


def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    statuses = ["view", "click", "purchase", "error", "signup", "replicated"]
    return history.status_rollup(_read(spark, folder, "events"), "user_id", "event_type", statuses)


def text_scalars(spark: SparkSession, folder: str) -> DataFrame:
    customer = _read(spark, folder, "customer")
    version = F.concat_ws(".", F.length("c_mktsegment"), _text("c_nationkey"), _text("c_custkey"))
    tags = F.when(F.col("c_acctbal") >= 0, F.array(version, "c_mktsegment")).otherwise(F.array().cast("array<string>"))
    rich = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))
    return customer.select(
        "c_custkey",
        name_hex(F.concat("c_name", F.lit("é"))).alias("hex"),
        env_name(F.concat("c_name", F.lit(".é-x"))).alias("env"),
        compat_version(version).alias("compat"),
        major_minor_tag(version).alias("minor"),
        package_name(F.col("c_name"), tags, compat_version(version)).alias("package"),
        list_text(tags).alias("listed"),
        name_or_path(rich, F.concat(F.lit("/p/"), "c_name")).alias("source"),
        config_present(rich, F.col("c_nationkey") < 3).alias("configured"),
        artifact_name(F.concat("c_name", F.lit(".tar.gz")), name_hex(F.col("c_mktsegment"))).alias("artifact"),
    )


def pair_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """Key-value texts of events in forms that are and are not pairs, and the flags of their values."""
    kind, k = F.col("event_type"), F.col("k")
    text = (
        F.when(kind == "click", F.concat(kind, F.lit("="), k))
        .when(kind == "view", F.concat(kind, F.lit("=")))
        .when(kind == "error", F.concat(F.lit("="), k))
        .when(kind == "signup", F.concat(kind, F.lit("="), k, F.lit("=")))
        .otherwise(F.concat(kind, F.lit("=="), k))
    )
    words = F.array(kind, F.concat(F.lit("-D"), kind, F.lit("="), k))
    text_of_events = _events(spark, folder).withColumn("text", text)
    text = F.col("text")
    return text_of_events.select(
        "event_id",
        is_pair(text).alias("valid"),
        pair_key(text).alias("key"),
        pair_value(text).alias("value"),
        F.array_join(flag_args("--arg", words), " ").alias("flags"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        service_catalog,
        service_uris,
        service_endpoints,
        service_uri_endpoints,
        descriptor_errors,
        descriptor_types,
        content_catalog,
        content_names,
        incremental_load,
        catalog_load,
        path_rules,
        pair_requests,
        tuple_requests,
        route_rules,
        acl_listing,
        acl_listing_udp,
        acl_listing_http,
        validation_report,
        valid_bundles,
        overlay_resolve,
        overlay_delta,
        overlay_chain,
        settings_manifest,
        default_endpoints,
        override_per_entity,
        override_global,
        manual_or_derived,
        uri_ports,
        exposed_ports,
        settings_fold,
        settings_record,
        install_plan,
        report_names,
        report_counts,
        manifest_emit,
        manifest_artifacts,
        manifest_files,
        manifest_tree,
        manifest_changes,
        detected_manifests,
        run_settings,
        resource_units,
        resource_normalize,
        route_match,
        route_matches,
        regex_matches,
        port_match,
        name_resolve,
        placement_candidates,
        placement_by_disk,
        unplaceable,
        compat_history,
        event_tail,
        status_rollup,
        text_scalars,
        pair_arguments,
    )
}
