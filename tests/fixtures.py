"""Endpoints and bundles in the shape the operators take."""

ACLS = (
    "array<struct<family:string,http:array<struct<method:string,path:string,is_regex:boolean,"
    "rewrite:string>>,ports:array<int>>>"
)
ENDPOINT = (
    "bundle string, label string, bind_protocol string, bind_port int, services array<string>, "
    f"service_name string, acls {ACLS}"
)
# Every form a rule can have: path, prefix and regex, each with and without method and rewrite.
HTTP_RULES = [
    ("DELETE", "/orders/old", False, "/archive"),
    (None, "^/shop", True, None),
    ("PUT", "/items/[0-9]+", True, None),
    (None, "/health", False, None),
    (None, "^/v1/users", True, "/users"),
    ("HEAD", "/ping", False, None),
    ("POST", "^/upload", True, None),
    (None, "/img/.*", True, "/static"),
    (None, "/legacy", False, "/new"),
    ("GET", "/a(b|c)", True, "/abc"),
    ("TRACE", "^/debug", True, "/off"),
    (None, "/x.*y$", True, None),
]
BASIC = [
    ("basic", "front", "http", 0, [], "front", None),
    ("basic", "uris", "http", 0, ["http://:7070/c", "http://:7070/a"], None, None),
    ("basic", "gossip", "tcp", 0, [], None, None),
    ("basic", "mixed", "http", 0, None, "mixed-service", [("http", HTTP_RULES, None), ("tcp", None, [7100, 7001]), ("udp", None, [5300, 53, 5300])]),
    ("basic", "nothing", "http", 0, None, None, []),
]
BUNDLE = (
    "name string, version string, tags array<string>, system string, system_version string, "
    "target_version string, enable_acls boolean, nr_of_cpus double, memory long, min_memory long, "
    "disk_space long, roles array<string>, annotations string, check_delay_ms long, checks array<string>, "
    "description string, start_command array<string>"
)
MIB = 1 << 20


def bundle(name, **fields):
    base = dict(
        name=name, version="0.1.0-SNAPSHOT", tags=None, system=None, system_version=None, target_version="2.0",
        enable_acls=True, nr_of_cpus=0.1, memory=64 * MIB, min_memory=64 * MIB, disk_space=10_000_000, roles=None,
        annotations=None, check_delay_ms=None, checks=None, description=name, start_command=[f"{name}/bin/{name}"],
    )
    assert not set(fields) - set(base)
    return tuple({**base, **fields}.values())


def rows(df, *order):
    """All rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [str(v) for v in r])
