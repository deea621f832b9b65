import json

from fixtures import BASIC, BUNDLE, ENDPOINT, MIB, bundle, rows

from fleetcatalog.operators.manifest import manifest_digests
from fleetcatalog.plans.distribution import apply_settings, distribute, write_manifests
from fleetcatalog.plans.local_run import run_settings


def test_distribution(spark, tmp_path):
    bundles = spark.createDataFrame([bundle("basic"), bundle("small", memory=MIB), bundle("over"), bundle("bad")], BUNDLE)
    web = ("http", 0, [], None, None)
    endpoints = spark.createDataFrame(
        [*BASIC, ("over", "old", *web), ("bad", "x", "http", 0, None, None, [("http", [(None, "^//x", True, None)], None)])],
        ENDPOINT,
    )
    override = spark.createDataFrame([("over", "new", *web)], ENDPOINT)
    defined = spark.createDataFrame([("over",)], "bundle string")
    made = distribute(bundles, endpoints, override, defined)
    assert rows(made.report.select("bundle", "rule")) == [("small", "memory")]
    assert rows(made.bad_rules.select("bundle", "error")) == [("bad", "^//x is not a plain path prefix")]
    documents = {(r.bundle, r.label): json.loads(r.document) for r in made.manifests.collect()}
    assert {b for b, _ in documents} == {"basic", "over"}
    assert [label for b, label in documents if b == "over" and label] == ["new"]
    digests = {r.bundle: r.digest for r in manifest_digests(made.manifests).collect()}
    for r in made.artifacts.collect():
        assert r.artifact == f"{r.bundle}-0.1.0-SNAPSHOT-{digests.pop(r.bundle)}.json"
    assert not digests
    write_manifests(made.manifests, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(made.manifests)


def test_apply_settings(spark):
    bundles = spark.createDataFrame([("a", "s1", 0.1, 5), ("b", "s2", 0.1, 6), ("c", None, 0.1, 7)], "name string, scope string, nr_of_cpus double, memory long")
    scopes = spark.createDataFrame([("p", None, False), ("s1", "p", True), ("s2", "s1", True)], "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame(
        [("p", "memory", "64"), ("s1", "nr_of_cpus", "2.5"), ("s2", "memory", "9"), ("s2", "other", "x")],
        "scope string, key string, value string",
    )
    assert rows(apply_settings(bundles, settings, scopes)) == [("a", "s1", 2.5, 64), ("b", "s2", 2.5, 9), ("c", None, 0.1, 7)]


def test_lists_and_maps_as_settings(spark):
    schema = "name string, scope string, tags array<string>, envs map<string,string>, checks array<string>"
    bundles = spark.createDataFrame([("a", "s", ["old"], {"k": "v"}, None), ("b", None, ["old"], None, ["x"])], schema)
    scopes = spark.createDataFrame([("p", None, False), ("s", "p", True)], "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame(
        [("p", "tags", '["t1","t2"]'), ("s", "envs", '{"a":"b"}'), ("s", "checks", "[]")], "scope string, key string, value string"
    )
    assert rows(apply_settings(bundles, settings, scopes)) == [("a", "s", ["t1", "t2"], {"a": "b"}, []), ("b", None, ["old"], None, ["x"])]


def test_run_settings(spark):
    args = spark.createDataFrame([("e", 1, "ports", "1111"), ("e", 2, "ports", "9001"), ("e", 3, "image", "i")], "entity string, seq int, field string, value string")
    def endpoints(*urls):
        return spark.createDataFrame([("e", list(urls)), ("f", ["http://:5"])], "entity string, services array<string>")

    base = endpoints("http://:9001/simple-test")
    override = endpoints("http://:9001", "http://h:7/x").filter("entity = 'e'")

    def ports(df):
        return sorted((r.entity, r.key) for r in df.filter("field = 'ports'").collect())

    # Run f has no override and keeps its own endpoints.
    assert ports(run_settings(args, base, override)) == [("e", "1111"), ("e", "7"), ("e", "9001"), ("f", "5")]
    assert ports(run_settings(args, base, override.limit(0))) == [("e", "1111"), ("e", "9001"), ("f", "5")]
