import random

import pytest
from fixtures import rows

from pyspark.sql import functions as F

from fleetcatalog.operators import placement
from fleetcatalog.operators.placement import dominating, placeable, placement_candidates, unplaceable
from fleetcatalog.store import durable


def fits(b, n):
    return all(b[i] <= n[i] for i in (1, 2, 3)) and (not b[4] or bool(set(b[4]) & set(n[4] or [])))


@pytest.mark.parametrize("roles", [1, 12, 32, 40])
def test_against_all_pairs(spark, roles):
    rng = random.Random(roles)
    names = [f"r{i}" for i in range(roles)]

    def some(i):
        few = [rng.choices(names, k=rng.randrange(1, 4)) for _ in range(4)]
        return (i, rng.randrange(1, 17) / 2, rng.randrange(100), rng.choice([10, 20, 40]), rng.choice([None, [], names, *few]))

    bundles, nodes = [some(i) for i in range(150)], [some(i) for i in range(120)]
    schema = "id int, cpus double, memory long, disk int, roles array<string>"
    got = placement_candidates(spark.createDataFrame(bundles, schema), spark.createDataFrame(nodes, schema), "id", ["cpus", "memory", "disk"])
    expected = [(b[0], sum(fits(b, n) for n in nodes)) for b in bundles]
    assert sorted(map(tuple, got.collect())) == expected
    none = [i for i, c in expected if c == 0]
    assert len(none) < 150
    assert sorted(r.id for r in unplaceable(got).collect()) == none
    assert placeable(got).count() == 150 - len(none)


def test_no_nodes(spark):
    schema = "id int, cpus double, roles array<string>"
    bundles = spark.createDataFrame([(1, 0.1, ["web"])], schema)
    assert rows(placement_candidates(bundles, spark.createDataFrame([], schema), "id", ["cpus"])) == [(1, 0)]


def test_all_roles_in_common(spark):
    schema = "id int, cpus double, roles array<string>"
    for count in (0, 33):
        row = [(1, 1.0, [f"r{i}" for i in range(count)])]
        one = spark.createDataFrame(row, schema)
        assert rows(placement_candidates(one, one, "id", ["cpus"])) == [(1, 1)]


def test_amounts_that_are_missing(spark):
    schema = "id int, cpus double, memory long, roles array<string>"
    bundles = spark.createDataFrame([(1, None, 1, []), (2, 1.0, 1, []), (2, 1.0, 1, [])], schema)
    nodes = spark.createDataFrame([(1, 5.0, None, []), (2, 5.0, 5, ["x"]), (3, 5.0, 5, ["x"]), (4, 1.0, 1, None)], schema)
    assert rows(placement_candidates(bundles, nodes, "id", ["cpus", "memory"])) == [(1, 0), (2, 3), (2, 3)]


def points(rng, count, width, node, ties):
    values = [0.0, 1.0, 2.0, 2.5] if ties else None
    place = lambda: [rng.choice(values) if ties and rng.random() < 0.6 else rng.random() * 3 for _ in range(width)]
    return [(rng.choice("gh"), node, None if node else i, place(), rng.randrange(1, 4) if node else None) for i in range(count)]


@pytest.mark.parametrize("width,ties", [(1, True), (2, True), (3, False), (3, True)])
def test_groups_cut_again_and_again(spark, width, ties):
    rng = random.Random(width)
    rows = points(rng, 3 * 8 * 5**width, width, True, ties) + points(rng, 90, width, False, ties)
    df = spark.createDataFrame(rows, "group string, of_node boolean, id long, place array<double>, n long")
    expected = {}
    for group, node, key, place, _ in rows:
        if not node:
            found = sum(n for g, of_node, _, held, n in rows if of_node and g == group and all(a >= b for a, b in zip(held, place, strict=True)))
            if found:
                expected[key] = found
    for pairs, held in ((1 << 30, 1 << 20), (3000, 10)):
        got = {r.id: r.candidates for r in dominating(df, width, pairs, held, 1).collect()}
        assert {k: v for k, v in got.items() if v} == expected, (pairs, held)


def test_rows_that_are_dealt(spark, monkeypatch):
    """Three amounts, cut until a task compares a ten-thousandth of all pairs: 20 rows for each node and demand at most."""
    written = []
    monkeypatch.setattr(placement, "durable", lambda df: written.append(durable(df)) or written[-1])
    rng = random.Random(9)
    rows = [("g", node, None if node else i, [rng.random() for _ in range(3)], 1 if node else None) for node in (True, False) for i in range(6000)]
    df = spark.createDataFrame(rows, "group string, of_node boolean, id long, place array<double>, n long").repartition(4)
    got = {r.id: r.candidates for r in dominating(df, 3, 1 << 18, 1 << 12, 16).collect()}
    some = [r for r in rows if not r[1]][::600]
    for r in some:
        assert got.get(r[2], 0) == sum(all(a >= b for a, b in zip(x[3], r[3], strict=True)) for x in rows if x[1])
    dealt = sum(w.count() for w in written if "place" in w.columns)
    assert 12_000 < dealt <= 20 * 12_000


def test_one_value_for_a_third_of_all(spark):
    """It is a border, so no slab has it."""
    rows = [("g", True, None, [1.0 if i % 3 == 0 else float(i), float(i % 7), float(i)], 1) for i in range(900)]
    rows += [("g", False, i, [1.0 if i % 3 == 0 else float(i), 0.0, 0.0], None) for i in range(300)]
    df = spark.createDataFrame(rows, "group string, of_node boolean, id long, place array<double>, n long")
    sizes = df.filter("of_node").groupBy(F.col("group").alias("of")).agg(F.count("*").alias("nodes"))
    cut = placement._cut(df, sizes, 3)
    slabs = cut.filter("of_node AND group LIKE 'g/0.%'").groupBy("group").count()
    assert slabs.agg(F.max("count")).first()[0] <= 900 / 2
    got = {r.id: r.candidates for r in dominating(df, 3, 5000, 1 << 20, 8).collect()}
    assert got[0] == 900 and got[299] == sum(1 for i in range(900) if (1 if i % 3 == 0 else i) >= 299)


def test_numbers_at_the_edges(spark):
    schema = "id int, cpus double, roles array<string>"
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, nan, []), (2, inf, []), (3, -inf, []), (4, 0.0, []), (5, -0.0, [])], schema)
    assert sorted(map(tuple, placement_candidates(rows, rows, "id", ["cpus"]).collect())) == [(1, 2), (2, 2), (3, 5), (4, 4), (5, 4)]
