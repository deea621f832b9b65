import hashlib

from fixtures import rows

from fleetcatalog.operators.contents import content_catalog, create_catalog, load_catalog, load_contents, new_contents, unknown_contents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, text string")


def test_catalog(spark):
    df = documents(spark, (3, "x"), (1, "x"), (2, "é"))
    assert rows(content_catalog(df, "id", "text")) == sorted([(sha("x"), 2, 1), (sha("é"), 1, 2)])


def test_new_contents(spark):
    catalog = content_catalog(documents(spark, (1, "a"), (2, "b")), "id", "text")
    batch = documents(spark, (7, "b"), (9, "c"), (8, "c"))
    assert rows(new_contents(batch, catalog, "id", "text")) == [(sha("c"), 8)]


def test_repeated_loads_change_nothing(spark, tmp_path):
    path = str(tmp_path / "catalog")
    first = documents(spark, (1, "a"), (2, "b"), (3, "a"))
    second = documents(spark, (4, "b"), (5, "c"))
    load_contents(first, path, "id", "text", "one")
    once = rows(load_contents(second, path, "id", "text", "two"))
    assert once == sorted([(sha("a"), 1, "one"), (sha("b"), 2, "one"), (sha("c"), 5, "two")])
    load_contents(second, path, "id", "text", "two")
    assert rows(load_contents(first, path, "id", "text", "one")) == once
    # The same contents under a new name add nothing.
    assert rows(load_contents(first, path, "id", "text", "three")) == once


def test_a_catalog_in_buckets(spark, tmp_path):
    create_catalog(spark, "kept", str(tmp_path / "kept"), 5)
    first = documents(spark, (1, "a"), (2, "b"), (3, "a"))
    second = documents(spark, (4, "b"), (5, "c"), (6, "c"), (7, None))
    load_catalog(first, "kept", "id", "text", "one")
    once = rows(load_catalog(second, "kept", "id", "text", "it's two"))
    assert once == sorted([(sha("a"), 1, "one"), (sha("b"), 2, "one"), (sha("c"), 5, "it's two"), (None, 7, "it's two")], key=lambda r: [str(v) for v in r])
    load_catalog(second, "kept", "id", "text", "it's two")
    assert rows(load_catalog(first, "kept", "id", "text", "one")) == once
    plan = unknown_contents(second, "kept", "id", "text", "three")._jdf.queryExecution().executedPlan().toString()
    # The last child of the join is the catalog: no line from there on is an exchange, whatever the number of shuffle partitions.
    batch, catalog = plan.rsplit("+- Sort", 1)
    assert "SortMergeJoin" in batch and batch.count("Exchange") == 2 and "Exchange" not in catalog and "Bucketed: true" in catalog
    spark.sql("DROP TABLE kept")
