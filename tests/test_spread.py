import random

import pytest

from fleetcatalog.operators.spread import _sliced, previous_value, running_total
from fleetcatalog.store import durable, release

SLICES = (1, 3, 16, None)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, some keys are null, orders are shuffled and in part equal."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, *(f"k{n}" for n in range(40))])
        data.append((key, rng.randrange(500), i, rng.choice([None, "x", "y", "z"]), rng.randrange(5)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, ts int, id int, v string, w long").repartition(6).cache()


def in_order(df):
    return sorted(df.collect(), key=lambda r: (r.ts, r.id))


@pytest.mark.parametrize("slices", SLICES)
def test_running_total(skewed, slices):
    expected, sums, seen = [], {}, {}
    for r in in_order(skewed):
        seen[r.k] = seen.get(r.k, 0) + 1
        sums[r.k] = sums.get(r.k, 0) + r.w
        expected.append((r.id, seen[r.k], sums[r.k]))
    counted = running_total(skewed, ["k"], ["ts", "id"], "pos", slices=slices)
    assert counted.columns == [*skewed.columns, "pos"]
    got = running_total(counted, ["k"], ["ts", "id"], "sum", "w", slices=slices).select("id", "pos", "sum")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.mark.parametrize("slices", SLICES)
def test_previous_value(skewed, slices):
    expected, last = [], {}
    for r in in_order(skewed):
        expected.append((r.id, last.get(r.k)))
        last[r.k] = r.v
    got = previous_value(skewed, ["k"], ["ts", "id"], "v", "prev", slices=slices)
    assert sorted((r.id, r.prev) for r in got.collect()) == sorted(expected)


def test_no_task_has_a_hot_group(skewed):
    """The rows of a slice are about as many as those of any other."""
    sizes = [r["count"] for r in _sliced(skewed, ["k"], ["ts", "id"], 12).groupBy("_slice").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 600


def test_empty(skewed):
    assert running_total(skewed.limit(0), ["k"], ["ts"], "pos").count() == 0
    assert previous_value(skewed.limit(0), ["k"], ["ts"], "v", "prev").count() == 0


def test_written_tables_can_be_removed(skewed):
    release(skewed.sparkSession)
    kept = durable(skewed)
    assert kept.count() == 3000
    assert release(skewed.sparkSession) == 1 and release(skewed.sparkSession) == 0
