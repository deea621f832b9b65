import pytest
from fixtures import BASIC, ENDPOINT, rows

from fleetcatalog.operators.routes import acl_listing, route_rules


def test_basic(spark):
    rules = route_rules(spark.createDataFrame(BASIC, ENDPOINT))
    got = [tuple(r)[2:] for r in rules.orderBy("acl_pos", "request_pos").collect()]
    assert got == [
        (0, 0, "http", "DELETE", "path", "/orders/old", "/archive", None, None),
        (0, 1, "http", None, "path-beg", "/shop", None, None, None),
        (0, 2, "http", "PUT", "path-regex", "/items/[0-9]+", None, None, None),
        (0, 3, "http", None, "path", "/health", None, None, None),
        (0, 4, "http", None, "path-beg", "/v1/users", "/users", None, None),
        (0, 5, "http", "HEAD", "path", "/ping", None, None, None),
        (0, 6, "http", "POST", "path-beg", "/upload", None, None, None),
        (0, 7, "http", None, "path-regex", "/img/.*", "/static", None, None),
        (0, 8, "http", None, "path", "/legacy", "/new", None, None),
        (0, 9, "http", "GET", "path-regex", "/a(b|c)", "/abc", None, None),
        (0, 10, "http", "TRACE", "path-beg", "/debug", "/off", None, None),
        (0, 11, "http", None, "path-regex", "/x.*y$", None, None, None),
        (1, 0, "tcp", None, "port", None, None, 7001, None),
        (1, 1, "tcp", None, "port", None, None, 7100, None),
        (2, 0, "udp", None, "port", None, None, 53, None),
        (2, 1, "udp", None, "port", None, None, 5300, None),
    ]


def test_repeats_stay_and_errors_are_told(spark):
    acls = [("http", [(None, "/a", False, None), (None, "/a", False, None), ("PATCH", "/b", False, None), (None, "^//c", True, None)], None)]
    df = spark.createDataFrame([("b", "l", "http", 0, None, None, acls)], ENDPOINT)
    got = [(r.kind, r.value, r.error) for r in route_rules(df).orderBy("request_pos").collect()]
    assert got == [
        ("path", "/a", None),
        ("path", "/a", None),
        ("path", "/b", "PATCH is not a known method"),
        (None, None, "^//c is not a plain path prefix"),
    ]
    with pytest.raises(Exception, match="not a plain path prefix|not a known method"):
        route_rules(df, strict=True).collect()


def test_strict_passes_good_rules(spark):
    df = spark.createDataFrame(BASIC, ENDPOINT)
    assert route_rules(df, strict=True).count() == 16


def test_acl_listing(spark):
    rules = route_rules(spark.createDataFrame(BASIC, ENDPOINT))
    assert [acl_listing(rules, f).count() for f in ("http", "tcp", "udp")] == [12, 2, 2]
    assert rows(acl_listing(rules, "udp").select("port")) == [(53,), (5300,)]
    with pytest.raises(ValueError):
        acl_listing(rules, "sctp")
