import pytest
from fixtures import rows

from fleetcatalog.operators.manifest import version_defaults
from fleetcatalog.operators.overrides import (
    default_endpoints,
    manual_or_derived,
    override_global,
    override_per_entity,
)
from fleetcatalog.operators.ports import exposed_ports, uri_ports

SCHEMA = "entity string, label string, port int"


def table(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_per_entity(spark):
    base = table(spark, ("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("c", "x", 4))
    override = table(spark, ("a", "z", 9))
    # b defines an override that is empty; it still replaces the base.
    defined = spark.createDataFrame([("a",), ("b",)], "entity string")
    assert rows(override_per_entity(base, override, defined, "entity")) == [("a", "z", 9), ("c", "x", 4)]


def test_global(spark):
    base = table(spark, ("a", "x", 1), ("b", "x", 3))
    assert rows(override_global(base, table(spark, ("a", "z", 9)))) == [("a", "z", 9)]
    assert rows(override_global(base, table(spark))) == rows(base)
    assert rows(override_global(base, table(spark, ("a", "z", 9)), within="entity")) == [("a", "z", 9), ("b", "x", 3)]


def test_manual_or_derived(spark):
    default = table(spark, ("same", "web", 0), ("field", "web", 0), ("more", "web", 0), ("fewer", "web", 0))
    manual = table(spark, ("same", "web", 0), ("field", "web", 7), ("more", "web", 0), ("more", "x", 1), ("only", "w", 5))
    names = ("same", "field", "more", "fewer", "only", "none")
    derived = table(spark, *[(n, "d", 1) for n in names])
    assert rows(manual_or_derived(manual, default, derived, "entity", "label", ["port"])) == sorted(
        [("field", "web", 7), ("more", "web", 0), ("more", "x", 1), ("only", "w", 5), ("same", "d", 1), ("none", "d", 1)]
    )


def test_lists_are_sets(spark):
    schema = (
        "entity string, label string, services array<string>, "
        "acls array<struct<family:string,http:array<struct<path:string>>,ports:array<int>>>"
    )
    acls = [("http", [("/b",), ("/a",)], None), ("tcp", None, [2, 1])]
    same = [("tcp", None, [1, 2, 1]), ("http", [("/b",), ("/a",)], None), ("tcp", None, [2, 1])]
    other_order = [("http", [("/a",), ("/b",)], None), ("tcp", None, [2, 1])]
    default = spark.createDataFrame([(e, "l", ["a", "b"], acls) for e in "pqrs"], schema)
    manual = spark.createDataFrame(
        [("p", "l", ["b", "a", "b"], same), ("q", "l", ["a", "b"], other_order), ("r", "l", ["a"], acls), ("s", "l", ["a", "b"], None)], schema
    )
    derived = spark.createDataFrame([(e, "d", [], []) for e in "pqrs"], schema)
    found = manual_or_derived(manual, default, derived, "entity", "label", ["services", "acls"])
    assert sorted((r.entity, r.label) for r in found.collect()) == [("p", "d"), ("q", "l"), ("r", "l"), ("s", "l")]


def test_exposed_ports(spark):
    uris = spark.createDataFrame(
        [("http://:9001",), ("http://h:91/x",), ("http://h/x",), ("http://:9001/again",), ("http://:oops",)], "uri string"
    )
    given = spark.createDataFrame([(91,), (5,)], "port int")
    assert rows(exposed_ports(uris, "uri")) == [(9001,), (91,)]
    assert rows(exposed_ports(uris, "uri", given)) == [(5,), (9001,), (91,)]
    assert [r.error for r in uri_ports(uris, "uri").collect()] == [None] * 4 + ["no port in http://:oops"]
    with pytest.raises(Exception, match="no port in http://:oops"):
        exposed_ports(uris, "uri", strict=True).collect()


def test_default_endpoints(spark):
    bundles = spark.createDataFrame(
        [("new", None, None), ("old", "1.1", None), ("off", "2.0", False)], "name string, target_version string, enable_acls boolean"
    )
    filled = version_defaults(bundles)
    assert rows(filled) == [("new", "2.0", True), ("off", "2.0", False), ("old", "1.1", False)]
    plain = {r.bundle: tuple(r)[1:] for r in default_endpoints(filled).collect()}
    assert plain == {
        "new": ("web", "http", 0, [], "web", None),
        "old": ("web", "http", 0, [], None, None),
        "off": ("web", "http", 0, [], None, None),
    }
    web = {r.bundle: r for r in default_endpoints(filled, web=True).collect()}
    assert (web["new"].services, web["new"].service_name) == (None, "web")
    assert [tuple(a.http[0]) for a in web["new"].acls] == [(None, "^/", True, None)]
    assert tuple(web["old"])[4:] == (["http://:9000"], None, None)
