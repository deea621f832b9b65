import json

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from fleetcatalog.operators.overrides import manual_or_derived
from fleetcatalog.operators.routes import route_rules
from fleetcatalog.operators.services import (
    acl_endpoints,
    declared_endpoints,
    descriptor_errors,
    parse_descriptors,
    service_rules,
    service_uris,
    uri_endpoints,
)

REMOTING = ("tcp", 0, [], None, [])


def descriptors(spark, *services, name="s"):
    data = [(name, json.dumps([{"name": n, "acls": [{"pathPattern": p} for p in patterns]} for n, patterns in services]))]
    return spark.createDataFrame(data, "descriptor_set string, json string")


def endpoints(df, item="rule"):
    """Header fields and sorted items of each endpoint; a header each, and nothing else in the rows of items."""
    out = {r.label: (r.bind_protocol, r.bind_port, r.services, r.service_name, []) for r in df.filter(f"{item} IS NULL").collect()}
    for r in df.filter(f"{item} IS NOT NULL").collect():
        assert (r.bind_protocol, r.bind_port, r.services, r.service_name) == (None,) * 4
        out[r.label][4].append(r[item])
    assert df.filter(f"{item} IS NULL").count() == len(out)
    return {label: (*fields, sorted(items)) for label, (*fields, items) in out.items()}


def test_two_services(spark):
    df = descriptors(spark, ("/rooms", [r"\Q/hotel/rooms\E"]), ("/guests", [r"\Q/hotel/guests\E"]))
    assert endpoints(acl_endpoints(df, ["descriptor_set"])) == {
        "rooms": ("http", 0, None, "rooms", ["^/hotel/rooms"]),
        "guests": ("http", 0, None, "guests", ["^/hotel/guests"]),
        "akka-remote": REMOTING,
    }


def test_service_without_rules(spark):
    got = endpoints(acl_endpoints(descriptors(spark, ("mailer", [])), ["descriptor_set"]))
    assert got["mailer"] == ("http", 0, [], "mailer", [])


def test_service_mode(spark):
    df = descriptors(spark, ("rooms", [r"\Q/hotel/rooms\E"]))
    got = endpoints(uri_endpoints(df, ["descriptor_set"]), "uri")
    assert got["rooms"] == ("http", 0, None, None, ["http://:9000/hotel/rooms?preservePath", "http://:9000/rooms"])
    assert got["akka-remote"] == REMOTING
    parsed = parse_descriptors(df, ["descriptor_set"])
    assert {r.uri for r in service_uris(parsed, ["descriptor_set"], 80).collect()} == {
        "http://:80/hotel/rooms?preservePath",
        "http://:80/rooms",
    }


@pytest.mark.parametrize(
    "pattern, rules",
    [
        ("/hotel/rooms", []),
        (r"\Q/\E", ["^/"]),
        (r"\Q/hotel/rooms/\E([0-9]+)\Q/beds\E", ["^/hotel/rooms"]),
    ],
)
def test_patterns(spark, pattern, rules):
    parsed = parse_descriptors(descriptors(spark, ("any", [pattern])), ["descriptor_set"])
    assert [r.rule for r in service_rules(parsed, ["descriptor_set"]).collect()] == rules


def test_patterns_at_any_depth(spark):
    acls = {"x": [{"rule": {"pathPattern": r"\Q/a\E"}}, {"pathPattern": r'\Q/q"é\E', "note": '"pathPattern":"\\Q/no\\E"'}]}
    data = [("s", json.dumps([{"name": "deep", "acls": acls}, {"name": "none"}, {"name": "null", "acls": None}]))]
    df = spark.createDataFrame(data, "descriptor_set string, json string")
    parsed = parse_descriptors(df, ["descriptor_set"])
    got = {r.service: sorted(r.prefixes) for r in parsed.collect()}
    assert got == {"deep": ["/a", '/q"é'], "none": [], "null": []}
    assert descriptor_errors(df).count() == 0


def test_same_name_twice(spark):
    df = descriptors(spark, ("a", [r"\Q/x\E"]), ("/a", [r"\Q/y\E", r"\Q/x/\E"]), ("/a", []))
    got = endpoints(acl_endpoints(df, ["descriptor_set"]))
    # One of the descriptors has no rules and so an empty list of services, which stays.
    assert got["a"] == ("http", 0, [], "a", ["^/x", "^/y"])


def test_one_slash_is_dropped(spark):
    parsed = parse_descriptors(descriptors(spark, ("//a", [])), ["descriptor_set"])
    assert parsed.first()["service"] == "/a"


def test_remoting_replaces_a_service_of_its_name(spark):
    df = descriptors(spark, ("akka-remote", [r"\Q/x\E"]))
    assert endpoints(acl_endpoints(df, ["descriptor_set"])) == {"akka-remote": REMOTING}


def test_empty_set_has_remoting(spark):
    df = descriptors(spark)
    assert endpoints(acl_endpoints(df, ["descriptor_set"])) == {"akka-remote": REMOTING}
    assert endpoints(uri_endpoints(df, ["descriptor_set"]), "uri") == {"akka-remote": REMOTING}


@pytest.mark.parametrize("count", [5, 1000, 1001])
def test_one_form_at_any_size(spark, count):
    df = descriptors(spark, ("a", [rf"\Q/p{i:04}\E" for i in range(count)]), ("b", [r"\Q/x\E"]))
    got = endpoints(acl_endpoints(df, ["descriptor_set"]))
    assert got["a"] == ("http", 0, None, "a", [f"^/p{i:04}" for i in range(count)])
    declared = {r.label: r for r in declared_endpoints(acl_endpoints(df, ["descriptor_set"]), "descriptor_set").collect()}
    assert [r.path for r in declared["a"].acls[0].http] == got["a"][4]


def test_white_space_before_the_list(spark):
    texts = ["\n" * n + " \t\r" * n + json.dumps([{"name": f"s{n}", "acls": [{"pathPattern": r"\Q/x\E"}]}]) for n in range(4)]
    df = spark.createDataFrame([(t,) for t in texts], "json string")
    assert sorted(r.service for r in parse_descriptors(df, []).collect()) == ["s0", "s1", "s2", "s3"]
    assert descriptor_errors(df).count() == 0


def test_prefixes_that_make_one_rule(spark):
    df = descriptors(spark, ("a", [r"\Q/\E", r"\Q//\E"]))
    parsed = parse_descriptors(df, ["descriptor_set"])
    assert sorted(parsed.first().prefixes) == ["", "/"]
    assert [r.rule for r in service_rules(parsed, ["descriptor_set"]).collect()] == ["^/"]
    assert endpoints(acl_endpoints(df, ["descriptor_set"]))["a"][4] == ["^/"]


def test_detected_endpoints_go_on_as_declared_ones(spark):
    df = descriptors(spark, ("rooms", [r"\Q/r\E", r"\Q//bad\E"]), ("mailer", []), name="hotel")
    declared = declared_endpoints(acl_endpoints(df, ["descriptor_set"]), "descriptor_set")
    assert rows(route_rules(declared).select("bundle", "label", "kind", "value", "error")) == [
        ("hotel", "rooms", None, None, "^//bad is not a plain path prefix"),
        ("hotel", "rooms", "path-beg", "/r", None),
    ]
    by_label = {r.label: r for r in declared.collect()}
    assert (by_label["mailer"].services, by_label["mailer"].acls, by_label["rooms"].services) == ([], None, None)
    assert (by_label["akka-remote"].bind_protocol, by_label["akka-remote"].acls) == ("tcp", None)
    uris = {r.label: r.services for r in declared_endpoints(uri_endpoints(df, ["descriptor_set"]), "descriptor_set").collect()}
    assert uris["mailer"] == ["http://:9000/mailer"] and uris["akka-remote"] == []
    default = declared.withColumn("services", F.coalesce("services", F.array().cast("array<string>")))
    changed = manual_or_derived(default.filter("label = 'rooms'"), default.filter("label = 'rooms'"), declared, "bundle", "label", declared.columns[2:])
    assert rows(changed.select("label")) == [("akka-remote",), ("mailer",), ("rooms",)]


def test_strict(spark):
    good = descriptors(spark, ("a", [r"\Q/x\E"]))
    assert parse_descriptors(good, ["descriptor_set"], strict=True).count() == 1
    bad = good.union(spark.createDataFrame([("s", '[{"acls": []}]')], good.schema))
    assert parse_descriptors(bad, ["descriptor_set"]).count() == 1
    with pytest.raises(Exception, match="not a list of service descriptors"):
        parse_descriptors(bad, ["descriptor_set"], strict=True).collect()


def test_errors(spark):
    good = json.dumps([{"name": "a"}])
    bad = ['{"name": "a"}', "[", json.dumps([{"acls": []}]), None, json.dumps([{"name": "a", "acls": [{"pathPattern": 5}]}])]
    df = spark.createDataFrame([(i, j) for i, j in enumerate([good, *bad])], "i int, json string")
    assert [r[0] for r in rows(descriptor_errors(df).select("i"))] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("value", ["7", "1.5", "true", "null", '["a"]', '{"a":"b"}'])
def test_only_texts_are_names(spark, value):
    good = '[{"name":"7","acls":[]}]'
    df = spark.createDataFrame([("s", good), ("s", good.replace('"7"', value)), ("s", f'[{good[1:-1]},{{"name":{value}}}]')], "descriptor_set string, json string")
    assert rows(descriptor_errors(df).select("json")) == rows(df.filter(F.col("json") != good).select("json"))
    assert {r.service for r in parse_descriptors(df, ["descriptor_set"]).collect()} == {"7"}
    with pytest.raises(Exception, match="not a list of service descriptors"):
        parse_descriptors(df, ["descriptor_set"], strict=True).collect()
