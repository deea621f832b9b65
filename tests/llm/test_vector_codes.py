import math
import random

import numpy as np
import pytest
from conftest_llm import EXTRA, as_in_sql
from pyspark.sql import functions as F

from fleetcatalog.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=16, parts=8, rounds=6):
    """(vec_id, label, code, error, label_error) and the codebooks, with every distance taken."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1]) if kept else 0
    width = -(-length // parts)
    whole = [[math.floor(c * 4096) for c in v] for _, v, _ in kept]
    able = [k for k, v in enumerate(whole) if len(v) == length and length and all(abs(c) < 1 << 26 for c in v)]
    part = {k: [(whole[k] + [0] * (parts * width - length))[p * width : (p + 1) * width] for p in range(parts)] for k in able}
    books = [[part[k][p] for k in able[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((apart(v, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for k in able:
                of.setdefault(near(p, part[k][p])[1], []).append(part[k][p])
            books[p] = [[sum(c) // len(of[j]) for c in zip(*of[j], strict=True)] if j in of else e for j, e in enumerate(books[p])]
    found = {k: [near(p, part[k][p]) for p in range(parts)] for k in able}
    error = {k: sum(d for d, _ in f) for k, f in found.items()}
    total = {}
    for k in able:
        total[kept[k][2]] = total.get(kept[k][2], 0) + error[k]
    out = [(i, x, "".join(f"{j:02x}" for _, j in found[k]) if k in found else None, error.get(k), total.get(x)) for k, (i, _, x) in enumerate(kept)]
    return sorted(out, key=str), books


def check(spark, rows, **settings):
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({n: F.lit(7) for n in EXTRA if n != "label"}), **settings)
    want, plain_books = plain(rows, **settings)
    assert sorted((tuple(r) for r in coded.collect()), key=str) == want
    assert books.tolist() == (plain_books if want and plain_books[0] else [[]] * len(plain_books))


def test_orchard_finds_the_nearest_entry():
    pick = np.random.default_rng(1)
    for size, width, spread in ((16, 8, 4000), (16, 2, 3), (5, 1, 2), (1, 3, 9), (64, 4, 5)):
        entries = pick.integers(-spread, spread + 1, (size, width))
        entries[size // 2] = entries[0]
        parts = np.concatenate([pick.integers(-2 * spread, 2 * spread + 1, (500, width)), entries])
        squared = ((parts[:, None] - entries[None]) ** 2).sum(2)
        entry, best = vector_codes.nearest(parts, vector_codes.listed(entries))
        assert entry.tolist() == squared.argmin(1).tolist() and best.tolist() == squared.min(1).tolist()


def test_neighbour_lists_rise_and_have_all_others():
    entries = np.random.default_rng(2).integers(-9, 9, (16, 3))
    book = vector_codes.listed(entries)
    assert (np.diff(book.squared, axis=1) >= 0).all()
    assert [sorted([i, *row]) for i, row in enumerate(book.others.tolist())] == [list(range(16))] * 16


def test_random_vectors(spark):
    pick = random.Random(4)
    rows = [(i, [pick.gauss(0, 0.2) for _ in range(16)], pick.choice([1, 2, None])) for i in range(300)]
    rows = [(i, np.float32(v).tolist(), x) for i, v, x in rows]
    check(spark, rows + rows[:40])
    check(spark, rows, entries=5, parts=4, rounds=2)


def test_odd_rows(spark):
    v = lambda *x: np.float32([*x, *[0.5] * (10 - len(x))]).tolist()
    rows = [
        (5, v(0.25), 1), (5, v(0.25), 1), (5, v(-0.25), None), (None, v(9.0), None), (2, None, 1), (1, v(float("nan")), 1), (0, v(float("inf")), 1),
        (3, [None, *v()[1:]], 1), (8, [0.5], 2), (9, [], 2), (7, v(1e30), 3), (6, v(20000.0), 1), (4, v(-1.0, 3.0), None),
    ]
    check(spark, rows)
    check(spark, rows[4:8])
    check(spark, [])
    check(spark, [(1, [], 1), (2, [], 1)])


@pytest.mark.parametrize("rows", [1, 7])
def test_equal_vectors_and_a_hot_label(spark, rows):
    check(spark, [(i, [0.125] * 8, 1) for i in range(rows)])


def test_decoded_vectors_are_near(spark):
    pick = np.random.default_rng(5)
    middle = pick.normal(0, 1, (4, 8))
    vectors = np.float32(middle[pick.integers(0, 4, 400)] + pick.normal(0, 0.001, (400, 8)))
    coded, books = vector_codes.compress(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(vectors)], SCHEMA))
    rows = coded.orderBy("vec_id").collect()
    codes = np.array([[int(r.code[2 * p : 2 * p + 2], 16) for p in range(8)] for r in rows])
    assert np.abs(vector_codes.decoded(codes, books) - vectors).max() < 0.01


def test_given_vectors_as_in_sql(spark):
    as_in_sql(spark, "op12_vector_codes")
