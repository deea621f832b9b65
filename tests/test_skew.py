"""Joins with a third of the rows under one key are split when they run."""

import re

import pytest
from fixtures import BUNDLE, ENDPOINT, bundle
from pyspark.sql import functions as F

from fleetcatalog.operators.manifest import bundle_names, manifest_emit, resource_normalize
from fleetcatalog.operators.matching import _pairs, route_match
from fleetcatalog.operators.overlay import resolve_settings
from fleetcatalog.operators.overrides import override_per_entity
from fleetcatalog.operators.services import acl_endpoints

ROWS = 60_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
}


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def third(other):
    """``hot`` for a third of the rows, else ``other``."""
    return F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(other)


def name(values):
    return F.concat(F.lit("u"), (F.col("id") % values).cast("string"))


def skewed_joins(df):
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return rows, re.findall(r"Join\(skew=true\).*", plan)


def test_manifest(small_partitions):
    spark = small_partitions
    # Spread over four partitions, each of them already in parts.
    ids = spark.range(0, ROWS, 1, 4)
    endpoints = ids.select(
        third(name(3000)).alias("bundle"),
        F.concat(F.lit("e"), "id").alias("label"),
        *[F.lit(None).cast(field.dataType).alias(field.name) for field in spark.createDataFrame([], ENDPOINT).schema[2:]],
    )
    names = ["hot", *[f"u{i}" for i in range(3000)]]
    bundles = resource_normalize(bundle_names(spark.createDataFrame([bundle(n) for n in names], BUNDLE)))
    rows, splits = skewed_joins(manifest_emit(bundles, endpoints).drop("document"))
    # Endpoints are dealt by bundle and label, so none of their groups is large; what is left is one join with the names.
    assert sum(r.label is not None for r in rows) == ROWS and sum(r.label is None for r in rows) == 3001
    assert sum(r.label is not None for r in rows if r.bundle == "hot") == ROWS // 3
    assert splits


def test_services(small_partitions):
    spark = small_partitions
    pattern = F.concat(F.lit(r"\Q/p"), "id", F.lit(r"\E"))
    described = F.array(F.struct(third(name(3000)).alias("name"), F.array(F.struct(pattern.alias("pathPattern"))).alias("acls")))
    descriptors = spark.range(0, ROWS, 1, 4).select(F.lit("s").alias("k"), F.to_json(described).alias("json"))
    rows = acl_endpoints(descriptors, ["k"]).collect()
    assert sum(r.rule is not None for r in rows) == ROWS
    assert sum(r.rule is not None for r in rows if r.label == "hot") == ROWS // 3


def test_route_match(small_partitions):
    spark = small_partitions
    requests = spark.range(0, ROWS, 1, 4).select(
        F.col("id").alias("request_id"), F.concat(F.lit("/"), third(name(3000))).alias("path"), F.lit("GET").alias("method")
    )
    rules = spark.sql("SELECT 'root' rule_id, 1 position, 'path-beg' kind, '/' value, CAST(NULL AS string) method, '/z' rewrite")
    rows, splits = skewed_joins(route_match(requests, rules))
    assert splits and len(rows) == ROWS and {r.matches for r in rows} == {1}


def test_paths_of_rules_without_a_beginning(small_partitions):
    """All paths have the key of a root or unanchored rule; they are dealt over buckets before they are joined."""
    spark = small_partitions
    paths = spark.range(0, ROWS, 1, 4).select(F.concat(F.lit("/p"), "id").alias("path"), F.lit("GET").alias("method"))
    rules = spark.sql(
        "SELECT 'root' rule_id, 1 position, 'path-beg' kind, '/' value, CAST(NULL AS string) method, '' rewrite "
        "UNION ALL SELECT 'odd', 2, 'path-regex', '.*[13579]$', NULL, '' UNION ALL SELECT 'long', 3, 'path-beg', '/p77', NULL, ''"
    )
    joined = _pairs(paths, rules)
    sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= 12 and max(r["count"] for r in sizes) < 3 * ROWS / len(sizes)
    found = {r.rule_id: r["count"] for r in joined.groupBy("rule_id").count().collect()}
    assert found == {"root": ROWS, "odd": ROWS // 2, "long": sum(str(i).startswith("77") for i in range(ROWS))}


def test_override(small_partitions):
    spark = small_partitions
    base = spark.range(0, ROWS, 1, 4).select(third(name(3000)).alias("entity"), "id")
    override = spark.range(50).select(F.concat(F.lit("u"), "id").alias("entity"), "id")
    rows, splits = skewed_joins(override_per_entity(base, override, override, "entity"))
    gone = sum(1 for i in range(ROWS) if i % 3 and i % 3000 < 50)
    assert splits and len(rows) == ROWS - gone + 50


def test_settings_of_one_parent(small_partitions):
    spark = small_partitions
    leaves = spark.range(0, ROWS, 1, 4).select(F.concat(F.lit("l"), "id").alias("scope"), third(name(500)).alias("parent"), F.lit(True).alias("is_config"))
    parents = leaves.select(F.col("parent").alias("scope")).distinct().select("scope", F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_config"))
    settings = parents.select("scope", F.lit("memory").alias("key"), F.col("scope").alias("value"))
    rows, splits = skewed_joins(resolve_settings(settings, leaves.union(parents)))
    assert splits and len(rows) == ROWS + parents.count()
    assert sum(r.value == "hot" for r in rows) == ROWS // 3 + 1
