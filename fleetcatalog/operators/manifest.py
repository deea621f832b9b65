"""Bundle manifests, and resource amounts in their final units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    binary_bytes,
    compat_version,
    decimal_bytes,
    package_name,
    round_up_kib,
    typed_request,
    version_rank,
    whole_seconds,
)
from ..functions.fixed import (
    CHECK_COMMAND,
    CHECK_DESCRIPTION,
    CHECK_LABEL,
    CHECK_SETTINGS,
    COMPONENT_SETTINGS,
    DEFAULT_CHECK_DELAY_MS,
    DEFAULT_FILE_SYSTEM_TYPE,
    DEFAULT_MIN_MEMORY_MIB,
    DEFAULT_ROLES,
    DEFAULT_TARGET_VERSION,
    FIRST_VERSION_WITH_ACLS,
    HEADER_SETTINGS,
    MANIFEST_VERSION,
    TARGET_VERSIONS,
    WEB_CPUS,
    WEB_DISK_MB,
    WEB_HEAP_MIB,
    WEB_MEMORY_MIB,
)
from .spread import durable, prefixed


def resource_normalize(bundles: DataFrame) -> DataFrame:
    """Fills amounts that are not set with the web-service defaults and adds derived ones.

    ``heap`` is rounded up to whole KiB; ``check_delay_s`` truncates to whole seconds, at least one.
    """
    def or_default(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default).alias(name)

    mib = lambda n: binary_bytes(F.lit(n), "MiB")
    filled = bundles.withColumns(
        {
            "nr_of_cpus": or_default("nr_of_cpus", F.lit(WEB_CPUS)),
            "memory": or_default("memory", mib(WEB_MEMORY_MIB)),
            "min_memory": or_default("min_memory", mib(DEFAULT_MIN_MEMORY_MIB)),
            "disk_space": or_default("disk_space", decimal_bytes(F.lit(WEB_DISK_MB), "MB")),
            "roles": or_default("roles", F.array(*[F.lit(r) for r in DEFAULT_ROLES])),
            "check_delay_ms": or_default("check_delay_ms", F.lit(DEFAULT_CHECK_DELAY_MS).cast("long")),
        }
    )
    heap = F.col("heap") if "heap" in bundles.columns else F.lit(None).cast("long")
    return filled.withColumns(
        {
            "heap": round_up_kib(F.coalesce(heap, mib(WEB_HEAP_MIB))),
            "check_delay_s": whole_seconds(F.col("check_delay_ms")),
        }
    )


def bundle_names(bundles: DataFrame) -> DataFrame:
    """``bundles`` with ``compat``, ``tags``, ``system`` and ``system_version`` filled, plus ``package``.

    Defaults: the version before its first dot, the version as only tag, the name, the
    compatibility version.
    """
    compat = compat_version(F.col("version"))
    columns = bundles.columns
    given = F.coalesce(F.col("compat"), compat) if "compat" in columns else compat
    return (
        bundles.withColumn("compat", given)
        .withColumn("tags", F.coalesce("tags", F.array("version")))
        .withColumn("system", F.coalesce("system", "name"))
        .withColumn("system_version", F.coalesce("system_version", "compat"))
        .withColumn("package", package_name(F.col("name"), F.col("tags"), F.col("compat")))
    )


def version_defaults(bundles: DataFrame) -> DataFrame:
    """``bundles`` with ``target_version`` and ``enable_acls`` filled: access rules are on where the target has them."""
    target = F.coalesce("target_version", F.lit(DEFAULT_TARGET_VERSION))
    supported = version_rank(F.col("target_version")) >= TARGET_VERSIONS.index(FIRST_VERSION_WITH_ACLS)
    return bundles.withColumn("target_version", target).withColumn("enable_acls", F.coalesce("enable_acls", supported))


def endpoint_document(endpoint: Column) -> Column:
    """Manifest form of one endpoint; what is null is left out of the JSON, what is empty is not."""
    def acl(a: Column) -> Column:
        def ports(family: str) -> Column:
            listed = F.array_sort(F.array_distinct(F.coalesce(a["ports"], F.array().cast("array<int>"))))
            return F.when(a["family"] == family, F.struct(listed.alias("requests"))).alias(family)

        http = F.when(
            a["family"] == "http", F.struct(F.transform(a["http"], typed_request).alias("requests"))
        )
        return F.struct(http.alias("http"), ports("tcp"), ports("udp"))

    return F.struct(
        endpoint["bind_protocol"].alias("bind-protocol"),
        endpoint["bind_port"].alias("bind-port"),
        endpoint["service_name"].alias("service-name"),
        F.array_sort(F.array_distinct(endpoint["services"])).alias("services"),
        F.transform(endpoint["acls"], acl).alias("acls"),
    )


ENDPOINT_FIELDS = ("bind_protocol", "bind_port", "services", "service_name", "acls")


def _components(name: Column, own: Column, checked: Column, check: Column) -> Column:
    """Components under their names; of a bundle named like the status check, the check, being the later one."""
    clash = checked & (name == CHECK_LABEL)
    listed = F.array(
        F.when(~F.coalesce(clash, F.lit(False)), F.struct(name.alias("key"), own.alias("value"))),
        F.when(checked, F.struct(F.lit(CHECK_LABEL).alias("key"), check.alias("value"))),
    )
    return F.map_from_entries(F.filter(listed, lambda c: c.isNotNull()))


def manifest_emit(bundles: DataFrame, endpoints: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The manifest of each bundle as JSON rows: ``(bundle, label, document)``.

    One row per bundle without label: the header, its component, and the status check if any
    checks are declared. One row per endpoint: its document, to stand under its label in the
    component's endpoints. The form is the same for any number of endpoints.

    ``bundles`` is as :func:`bundle_names` and :func:`resource_normalize` leave it, with
    ``description``, ``start_command``, ``checks`` and ``annotations``; ``endpoints`` has rows by
    bundle and label. Of several with one label the last by the columns ``order`` counts, or the greatest if
    there is no order. A null field is left out of the JSON. Bundles without name, endpoints
    without label and those of other bundles are left out.
    """
    entry = F.struct(*ENDPOINT_FIELDS)
    last = F.max_by(entry, F.struct(*order)) if order else F.max(entry)
    # Hardly any label is there twice, so nothing is gained by an aggregate before the shuffle.
    dealt = endpoints.filter(F.col("label").isNotNull()).repartition("bundle", "label")
    single = dealt.groupBy("bundle", "label").agg(last.alias("_entry"))
    named = bundles.filter(F.col("name").isNotNull())
    owned = single.join(named.select(F.col("name").alias("bundle")), "bundle", "left_semi")
    entries = owned.select("bundle", "label", F.to_json(endpoint_document(F.col("_entry"))).alias("document"))

    def component(description: Column, command: Column) -> Column:
        return F.struct(
            description.alias("description"),
            F.lit(DEFAULT_FILE_SYSTEM_TYPE).alias("file-system-type"),
            command.alias("start-command"),
        )

    words = F.array(*[F.lit(word) for word in CHECK_COMMAND], F.col("check_delay_s").cast("string"))
    own = component(F.col("description"), F.col("start_command"))
    check = component(F.lit(CHECK_DESCRIPTION), F.concat(words, F.col("checks")))
    header = F.struct(
        F.lit(MANIFEST_VERSION).alias("version"),
        "name",
        F.col("compat").alias("compatibilityVersion"),
        "tags",
        "annotations",
        "system",
        F.col("system_version").alias("systemVersion"),
        F.col("nr_of_cpus").alias("nrOfCpus"),
        "memory",
        F.col("disk_space").alias("diskSpace"),
        F.array_sort(F.array_distinct("roles")).alias("roles"),
        _components(F.col("name"), own, F.coalesce(F.size("checks") > 0, F.lit(False)), check).alias("components"),
    )
    headers = named.select(F.col("name").alias("bundle"), F.lit(None).cast("string").alias("label"), F.to_json(header).alias("document"))
    return headers.unionByName(entries)


# Children of a node of a hash tree: one for each hex digit. A leaf has so many endpoints on average, at most.
FANOUT, DEEPEST = 16, 15

# Levels of a hash tree above its leaves that are built where the endpoints are dealt, in one task each.
SUBTREE = 2

# Documents longer than this are dealt as their digest. Shorter ones take less room than a digest, being compressed.
DEALT_BYTES = 256


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _levels(endpoints: DataFrame) -> DataFrame:
    """``(of, level)``: the level of the leaves of each bundle that has more than a root, which are few beside the endpoints."""
    counts = endpoints.groupBy(F.col("bundle").alias("of")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FANOUT)
    level = sum((F.col("n") > FANOUT ** (k + 1)).cast("int") for k in range(DEEPEST))
    return durable(counts.select("of", level.alias("level")))


def _parent(kids: Column) -> Column:
    return _digest(F.array_join(F.array_sort(F.transform(kids, lambda k: F.concat(k["node"], F.lit(":"), k["hash"]))), ","))


def _tree(manifests: DataFrame) -> DataFrame:
    """The rows of :func:`manifest_tree` and whether they are a ``leaf``, with hashes as bytes.

    Endpoints are shuffled once, by the node that is ``SUBTREE`` levels above their leaf, and their digests are made
    after that, as they can't be compressed. All nodes up to that one are built in its task; it has few children
    on every level, so no task has a whole bundle. Levels above have a row for thousands of endpoints.
    """
    endpoints = manifests.filter(F.col("bundle").isNotNull() & F.col("label").isNotNull()).select("bundle", "label", "document")
    levels = _levels(endpoints)
    deepest = levels.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    at = _digest(F.col("label"))
    own = _digest(F.concat("label", F.lit(":"), "document"))
    long = F.octet_length("document") > DEALT_BYTES
    dealt = endpoints.join(levels, F.col("bundle") == F.col("of"), "left").withColumn("level", F.coalesce("level", F.lit(0)))
    dealt = dealt.select(
        "bundle", "level", "label", F.when(F.col("level") > SUBTREE, F.left(at, F.col("level") - SUBTREE)).otherwise("").alias("top"),
        F.when(~long, F.col("document")).alias("document"), F.when(long, F.unhex(own)).alias("own"),
    ).repartition("bundle", "top")
    parted = dealt.select("bundle", "level", "top", at.alias("at"), F.coalesce(F.lower(F.hex("own")), own).alias("own"))
    group, total = ["bundle", "level", "top"], F.sum("n").alias("n")
    parts = F.collect_list(F.concat("at", "own"))
    built = parted.groupBy(*group, F.left("at", F.col("level")).alias("node")).agg(F.count(F.lit(1)).alias("n"), _digest(F.array_join(F.array_sort(parts), ",")).alias("hash"))
    listed = F.struct("node", "n", "hash", F.col("level").alias("at"), F.lit(True).alias("leaf"))
    built = built.select(*group, "node", "n", "hash", F.array(listed).alias("below"))
    for up in range(1, SUBTREE + 1):
        # Bundles that have no such level keep what they have, which is their root.
        there = F.col("level") >= up
        node = F.when(there, F.left("node", F.col("level") - up)).otherwise(F.col("node"))
        kids = F.collect_list(F.struct("node", "n", "hash", "below"))
        built = built.groupBy(*group, node.alias("up")).agg(total, kids.alias("kids"))
        hash_ = F.when(there, _parent(F.col("kids"))).otherwise(F.element_at("kids", 1)["hash"])
        built = built.select(*group, F.col("up").alias("node"), "n", hash_.alias("hash"), F.flatten("kids.below").alias("below"))
        own_row = F.struct("node", "n", "hash", (F.col("level") - up).alias("at"), F.lit(False).alias("leaf"))
        built = built.withColumn("below", F.when(there, F.concat("below", F.array(own_row))).otherwise(F.col("below")))
    columns = ["bundle", F.col("at").alias("level"), "node", F.col("n").alias("endpoints"), F.unhex("hash").alias("hash"), "leaf"]
    out = built.select("bundle", F.inline("below")).select(*columns)
    if deepest <= SUBTREE:
        return out
    out = durable(out)
    tops = levels.filter(F.col("level") > SUBTREE).select("of", (F.col("level") - SUBTREE).alias("_top"))
    pending = out.join(tops, (F.col("bundle") == F.col("of")) & (F.col("level") == F.col("_top"))).select("bundle", "level", "node", "endpoints", "hash")
    pending = durable(pending)
    for level in range(deepest - SUBTREE - 1, -1, -1):
        kids = F.collect_list(F.struct("node", F.lower(F.hex("hash")).alias("hash")))
        below = pending.filter(F.col("level") == level + 1)
        made = below.groupBy("bundle", F.left("node", F.lit(level)).alias("up")).agg(F.sum("endpoints").alias("endpoints"), F.unhex(_parent(kids)).alias("hash"))
        # Read for this level and by the one above.
        made = durable(made.select("bundle", F.lit(level).alias("level"), F.col("up").alias("node"), "endpoints", "hash"))
        out = out.unionByName(made.withColumn("leaf", F.lit(False)))
        pending = pending.unionByName(made)
    return out


def manifest_tree(manifests: DataFrame) -> DataFrame:
    """The hash tree over the endpoints of each bundle: ``(bundle, level, node, endpoints, hash)``.

    ``manifests`` has the rows of :func:`manifest_emit`. An endpoint stands below the leaf that the first hex
    digits of its label's SHA-256 name, as many as leave about ``FANOUT`` endpoints to a leaf. The hash of a leaf is SHA-256 over
    its endpoints' own, in the order of their labels' digests; that of any other node is over its children's names and
    hashes, in order. The root has level 0 and an empty name. So a changed endpoint changes the nodes above it only, no
    node has many children, and the tree does not depend on partitions. Bundles without endpoints have none.
    """
    return _tree(manifests).select("bundle", "level", "node", "endpoints", F.lower(F.hex("hash")).alias("hash"))


def manifest_digests(manifests: DataFrame) -> DataFrame:
    """``(bundle, endpoints, digest)`` of the rows of :func:`manifest_emit`, which are read twice.

    The digest is SHA-256 over the header, the number of endpoints and the root of their hash tree.
    """
    roots = _tree(manifests).filter("level = 0").select(F.col("bundle").alias("of"), "endpoints", "hash")
    headers = manifests.filter(F.col("label").isNull()).select("bundle", "document")
    count = F.coalesce("endpoints", F.lit(0).cast("long"))
    text = F.concat_ws(":", "document", count.cast("string"), F.coalesce(F.lower(F.hex("hash")), F.lit("")))
    joined = headers.join(roots, F.col("bundle") == F.col("of"), "left")
    return joined.select("bundle", count.alias("endpoints"), F.sha2(text.cast("binary"), 256).alias("digest"))


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(bundle, label, node, change)``: endpoints that are not the same in two versions, as ``added``, ``removed`` or ``changed``.

    ``node`` is the leaf above the endpoint, of the version that has it, or the newer. Endpoints are compared
    only below leaves that differ, so equal subtrees cost a row for each leaf. A header is no endpoint, and what changes in
    it is not listed.
    """
    # A node above leaves never has a leaf's hash, so leaves are compared with leaves.
    before, after = (_tree(x).filter("leaf").select("bundle", "level", "node", "hash") for x in (old, new))
    known = prefixed(after, after.columns, "_k_")
    both = before.join(known, (F.col("bundle") == F.col("_k_bundle")) & (F.col("level") == F.col("_k_level")) & (F.col("node") == F.col("_k_node")), "full")
    unequal = durable(both.filter(~F.col("hash").eqNullSafe(F.col("_k_hash"))).drop("hash", "_k_hash"))

    def suspects(manifests: DataFrame, bundle: str, level: str, leaf: str) -> DataFrame:
        differing = unequal.filter(F.col(bundle).isNotNull()).select(F.col(bundle).alias("of"), F.col(level).alias("depth"), F.col(leaf).alias("leaf"))
        levels = differing.select(F.col("of").alias("in"), "depth").distinct()
        rows = manifests.filter(F.col("label").isNotNull()).join(levels, F.col("bundle") == F.col("in"))
        rows = rows.withColumn("node", F.expr("left(sha2(CAST(label AS BINARY), 256), depth)"))
        return rows.join(differing, (F.col("bundle") == F.col("of")) & (F.col("node") == F.col("leaf")), "left_semi").select("bundle", "label", "document", "node")

    one = suspects(old, "bundle", "level", "node")
    two = prefixed(suspects(new, "_k_bundle", "_k_level", "_k_node"), one.columns, "_t_")
    joined = one.join(two, (F.col("bundle") == F.col("_t_bundle")) & (F.col("label") == F.col("_t_label")), "full")
    change = F.when(F.col("label").isNull(), "added").when(F.col("_t_label").isNull(), "removed").otherwise("changed")
    unequal_rows = joined.filter(~F.col("document").eqNullSafe(F.col("_t_document")))
    return unequal_rows.select(F.coalesce("bundle", "_t_bundle").alias("bundle"), F.coalesce("label", "_t_label").alias("label"), F.coalesce("_t_node", "node").alias("node"), change.alias("change"))


def settings_manifest(resolved: DataFrame, full: bool) -> DataFrame:
    """A JSON document per target from its resolved settings: ``(target, manifest)``.

    ``resolved`` is ``(target, key, value, scope)`` with values as text, those of list and map
    fields as JSON. With ``full`` all fields are written, else only those a configuration
    supplies, and nothing for a target of which no field but the checks is supplied. The component
    is always named after the target's name, or the target if it has none. A target has one row per setting name at most.
    """
    shown = F.lit(full) | F.col("scope").isNotNull()

    def value(key: str, type_: str, when: Column) -> Column:
        text = F.max(F.when((F.col("key") == key) & when, F.col("value")))
        typed = F.from_json(text, type_) if type_.startswith(("array", "map")) else text.cast(type_)
        return typed.alias(key)

    types = {**HEADER_SETTINGS, **COMPONENT_SETTINGS, "checks": CHECK_SETTINGS["checks"]}
    known = F.col("key").isin(*HEADER_SETTINGS, *COMPONENT_SETTINGS)
    wide = resolved.groupBy("target").agg(
        *[value(key, type_, shown) for key, type_ in types.items()],
        value("name", "string", F.lit(True)).alias("_name"),
        value("checkInitialDelay", CHECK_SETTINGS["checkInitialDelay"], F.lit(True)).alias("_delay"),
        F.bool_or(shown & known).alias("_any"),
    )
    delay = whole_seconds(F.coalesce("_delay", F.lit(DEFAULT_CHECK_DELAY_MS).cast("long")))
    words = F.array(*[F.lit(word) for word in CHECK_COMMAND], delay.cast("string"))
    none = F.map_filter("endpoints", lambda k, v: F.lit(False))
    check = F.struct(
        F.lit(CHECK_DESCRIPTION).alias("description"),
        F.lit(DEFAULT_FILE_SYSTEM_TYPE).alias("file-system-type"),
        F.concat(words, F.col("checks")).alias("start-command"),
        F.coalesce(none, F.from_json(F.lit("{}"), COMPONENT_SETTINGS["endpoints"])).alias("endpoints"),
    )
    own = F.struct(*[F.col(f"`{key}`") for key in COMPONENT_SETTINGS])
    components = _components(F.coalesce("_name", "target"), own, F.coalesce(F.size("checks") > 0, F.lit(False)), check)
    document = F.struct(
        F.lit(MANIFEST_VERSION).alias("version"),
        *HEADER_SETTINGS,
        components.alias("components"),
    )
    return wide.filter("_any").select("target", F.to_json(document).alias("manifest"))
