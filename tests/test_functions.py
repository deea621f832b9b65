import pytest
from fixtures import rows
from pyspark.sql import functions as F

from fleetcatalog import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, is_regex, kind, value",
    [
        ("/my-path", False, "path", "/my-path"),
        (r"^/my-path/\.+.html$", True, "path-regex", r"^/my-path/\.+.html$"),
        ("^/", True, "path-beg", "/"),
        ("^/mypath", True, "path-beg", "/mypath"),
        ("^/my-path", True, "path-beg", "/my-path"),
        ("^/my_path", True, "path-beg", "/my_path"),
        (r"^/my-path/\w+/foo", True, None, None),
        ("^//my-path", True, None, None),
        ("^/my-path//foo", True, None, None),
        ("/regex1/[a|b|c]", True, "path-regex", "/regex1/[a|b|c]"),
        ("^/a/", True, "path-beg", "/a/"),
        ("^/a//", True, None, None),
        ("^/a\n", True, None, None),
    ],
)
def test_typed_path(spark, path, is_regex, kind, value):
    got = one(spark, fn.typed_path(F.lit(path), F.lit(is_regex)))
    assert (got["kind"], got["value"]) == (kind, value)
    assert (got["error"] is None) == (kind is not None)


@pytest.mark.parametrize(
    "pattern, prefix",
    [
        ("/api/users", None),
        (r"\Q/\E", ""),
        (r"\Q/api/users\E", "/api/users"),
        (r"\Q/api/users/\E([^/]+)", "/api/users"),
        (r"\Q/api/users/\E([^/]+)\Q/friends\E", "/api/users"),
        (r"\Qapi\E", None),
        ("\\Q/a\\E\n", None),
        (r"\Q//\E", "/"),
    ],
)
def test_path_prefix(spark, pattern, prefix):
    assert one(spark, fn.path_prefix(F.lit(pattern))) == prefix


def test_pair_request(spark):
    assert tuple(one(spark, fn.pair_request(F.lit("GET"), F.lit("/bar-2")))) == ("GET", "/bar-2", False, None)
    assert tuple(one(spark, fn.pair_request(F.lit("/bar-2"), F.lit("/bar-3")))) == (None, "/bar-2", False, "/bar-3")
    # PATCH is no known method.
    assert one(spark, fn.pair_request(F.lit("PATCH"), F.lit("/x")))["path"] == "PATCH"


@pytest.mark.parametrize(
    "size, rounded", [(0, 1024), (1, 1024), (1024, 1024), (1025, 2048), (128 << 20, 128 << 20)]
)
def test_round_up_kib(spark, size, rounded):
    assert one(spark, fn.round_up_kib(F.lit(size))) == rounded


def test_units(spark):
    assert [one(spark, fn.decimal_bytes(F.lit(3), u)) for u in ("KB", "MB", "GB", "TB")] == [3 * 1000**i for i in range(1, 5)]
    assert [one(spark, fn.binary_bytes(F.lit(3), u)) for u in ("KiB", "MiB", "GiB", "TiB")] == [3 * 1024**i for i in range(1, 5)]


@pytest.mark.parametrize("millis, seconds", [(0, 1), (999, 1), (1400, 1), (1999, 1), (3000, 3), (61_500, 61)])
def test_whole_seconds(spark, millis, seconds):
    assert one(spark, fn.whole_seconds(F.lit(millis))) == seconds


@pytest.mark.parametrize(
    "uri, port",
    [
        ("http://:9000", 9000),
        ("http://:9001/simple-test", 9001),
        ("http://h:91/x", 91),
        ("http://h/x", -1),
        ("http://h:/x", -1),
        ("http://[::1]:91", 91),
        ("http://[::1]", -1),
        ("http://:port", None),
        ("http://a_b:91", None),
        ("/x", None),
        (None, None),
    ],
)
def test_uri_port(spark, uri, port):
    assert one(spark, fn.uri_port(F.lit(uri).cast("string"))) == port


@pytest.mark.parametrize(
    "text, pair",
    [
        ("key1=value1", ("key1", "value1")),
        ("a=", None),
        ("=b", ("", "b")),
        ("a=b=c", None),
        ("a==b", None),
        ("a=b=", ("a", "b")),
        ("a=b==", ("a", "b")),
        ("a", None),
        ("", None),
        ("==", None),
        ("a=b=\n", None),
    ],
)
def test_pairs(spark, text, pair):
    text = F.lit(text)
    assert one(spark, fn.is_pair(text)) is (pair is not None)
    assert (one(spark, fn.pair_key(text)), one(spark, fn.pair_value(text))) == (pair or (None, None))


def test_names(spark):
    assert one(spark, fn.name_hex(F.lit("fleet-service"))) == "fleet-service".encode().hex()
    assert one(spark, fn.env_name(F.lit("my.bundle-1é"))) == "MY_BUNDLE_1_"
    assert [one(spark, fn.compat_version(F.lit(v))) for v in ("0.1.0-SNAPSHOT", "2", ".1")] == ["0", "2", ""]
    assert [one(spark, fn.major_minor_tag(F.lit(v))) for v in ("2.5.6", "1.3.5", "2.10.1")] == ["25", "13", "21"]
    tags = F.array(F.lit("1.0.0"), F.lit("x"))
    none = F.array().cast("array<string>")
    assert one(spark, fn.package_name(F.lit("n"), tags, F.lit("1"))) == "n-1.0.0"
    assert one(spark, fn.package_name(F.lit("n"), none, F.lit("1"))) == "n-v1"
    assert one(spark, fn.list_text(tags)) == '["1.0.0", "x"]'
    assert one(spark, fn.list_text(none)) == "[]"
    assert one(spark, fn.artifact_name(F.lit("a.b.zip"), F.lit("d"))) == "a.b-d.zip"
    assert one(spark, fn.artifact_name(F.lit("ab"), F.lit("d"))) == "ab-d"


def test_config_present(spark):
    df = spark.createDataFrame([(None, None), ("", False), ("x", False), (None, True)], "t string, d boolean")
    assert [r[0] for r in df.select(fn.config_present(F.col("t"), F.col("d"))).collect()] == [False, False, True, True]


@pytest.mark.parametrize(
    "flag, values, words",
    [
        ("--enable-feature", ["false", "true"], ["--enable-feature", "false", "--enable-feature", "true"]),
        ("--greeting", ["hello world", "hi"], ["--greeting", "hello world", "--greeting", "hi"]),
        ("--arg", ["false", "-Denable=false"], ["--arg", "false", "--arg=-Denable=false"]),
        ("--arg", [], []),
    ],
)
def test_flag_args(spark, flag, values, words):
    df = spark.createDataFrame([(values,)], "v array<string>")
    assert df.select(fn.flag_args(flag, F.col("v"))).first()[0] == words


def test_known_method(spark):
    df = spark.createDataFrame([("GET",), ("CONNECT",), ("PATCH",), ("OPTIONS",)], "m string")
    assert rows(df.filter(fn.known_method(F.col("m")))) == [("CONNECT",), ("GET",)]
