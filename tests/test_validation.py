import pytest
from fixtures import BASIC, BUNDLE, ENDPOINT, MIB, bundle, rows
from pyspark.sql import functions as F

from fleetcatalog.operators.validation import InvalidBundles, require_valid, valid_bundles, violations

BOTH = ("both", "web", "http", 0, [], None, [("http", [(None, "/a", False, None)], None)])


@pytest.fixture(scope="module")
def report(spark):
    bundles = spark.createDataFrame(
        [
            bundle("basic"),
            bundle("small", memory=32 * MIB),
            bundle("both"),
            bundle("old", target_version="1.1"),
            bundle("old-off", target_version="1.1", enable_acls=False),
            bundle("all", target_version="1.1", memory=1),
        ],
        BUNDLE,
    )
    endpoints = spark.createDataFrame([*BASIC, BOTH, ("all", "x", "http", 0, ["u"], None, [])], ENDPOINT)
    return bundles, violations(bundles, endpoints)


def test_violations(report):
    _, told = report
    assert rows(told.select("bundle", "rule", "label")) == [
        ("all", "endpoint", "x"),
        ("all", "memory", None),
        ("all", "version", None),
        ("both", "endpoint", "web"),
        ("old", "version", None),
        ("small", "memory", None),
    ]
    assert told.filter("bundle = 'small'").first().message == "memory of 32 MiB is below the minimum of 64 MiB"


def test_valid_bundles(report):
    bundles, told = report
    assert rows(valid_bundles(bundles, told).select("name")) == [("basic",), ("old-off",)]


def test_one_failure_for_all(report):
    _, told = report
    with pytest.raises(InvalidBundles) as failure:
        require_valid(told)
    text = str(failure.value)
    assert "2 x version" in text and "2 x endpoint" in text and "2 x memory" in text and failure.value.place in text
    told = told.sparkSession.read.parquet(failure.value.place)
    # All of them; within a bundle: version, endpoints, memory.
    assert told.count() == 6
    assert [r.rule for r in told.filter("bundle = 'all'").collect()] == ["version", "endpoint", "memory"]
    require_valid(told.filter("bundle = 'basic'"))


def test_every_violation_is_kept(spark, tmp_path):
    bundles = spark.createDataFrame([bundle(f"b{i}", memory=1) for i in range(1001)], BUNDLE)
    with pytest.raises(InvalidBundles) as failure:
        require_valid(violations(bundles, spark.createDataFrame([], ENDPOINT)), str(tmp_path / "bad"))
    assert failure.value.place == str(tmp_path / "bad")
    assert spark.read.parquet(failure.value.place).count() == 1001


def test_the_report_is_evaluated_once(report, tmp_path):
    """Each row of the report passes a counter on its way; nothing is left where there is nothing to tell."""
    _, told = report
    seen = told.sparkSession.sparkContext.accumulator(0)
    passed = F.udf(lambda rule: seen.add(1) or rule)
    with pytest.raises(InvalidBundles):
        require_valid(told.withColumn("rule", passed("rule")), str(tmp_path / "bad"))
    assert seen.value == 6
    require_valid(told.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
