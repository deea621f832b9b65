import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import DATA, DOCS, ODD, table

from fleetcatalog.llm import near_dedup, queries
from fleetcatalog.llm.components import components


def kmers(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def subsequence(a, b):
    row = np.zeros(len(b) + 1, int)
    for x in a:
        new = row.copy()
        for j, y in enumerate(b):
            new[j + 1] = row[j] + 1 if x == y else max(new[j], row[j + 1])
        row = new
    return int(row[-1])


def classes(rows):
    """Class of each row by all pairs; the pairs' similarities."""
    sets = [kmers(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b:
                group[root(i)] = root(j)
            elif len(set(a) & set(b)) * 9 >= (len(a) + len(b)) * 2:
                s = subsequence(a, b)
                if s and s / (len(a) + len(b) - s) >= 0.8:
                    group[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def partition(keys, groups):
    out = {}
    for k, g in zip(keys, groups, strict=True):
        out.setdefault(g, []).append(k)
    return sorted((sorted(v, key=lambda k: (k is None, k or 0)) for v in out.values()), key=str)


def check(spark, rows):
    found = near_dedup.near_duplicates(table(spark, rows)).collect()
    want = partition([k for k, _ in rows], classes(rows))
    assert partition([r.doc_id for r in found], [r.class_id for r in found]) == want
    assert sorted(r.doc_id for r in found if r.kept) == sorted(v[0] for v in want)
    assert all(r.class_size == next(len(v) for v in want if r.doc_id in v) for r in found)


def copies(seed, bases=9, each=5, size=80):
    pick, rows = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{pick.randrange(400)}" for _ in range(size)]
        for _ in range(each):
            w = list(base)
            for _ in range(pick.randrange(5)):
                at = pick.randrange(len(w))
                w[at : at + pick.randrange(2)] = [f"n{pick.randrange(400)}"] * pick.randrange(2)
            rows.append((len(rows), " ".join(w)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_brute_force(spark, seed):
    check(spark, copies(seed))


def test_one_large_group_and_a_common_passage(spark):
    pick = random.Random(5)
    base, passage = [f"w{i}" for i in range(100)], " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(pick.randrange(100) for _ in range(30))]
    rows += [(100 + i, passage + " " + " ".join(f"y{pick.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    check(spark, rows)


def test_a_chain_is_one_class(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([f"n{i}" if i < 6 * k else w for i, w in enumerate(base)])) for k in range(5)]
    check(spark, rows)


@pytest.mark.parametrize("size", [12, 60, 400])
def test_similar_texts_meet(size):
    """At the least similarity texts meet in a table."""
    pick, kmers, first = np.random.default_rng(size), [], [0]
    for _ in range(300):
        one = pick.integers(1, 2**63, size, dtype=np.uint64)
        other = one.copy()
        other[pick.choice(size, size - -(-size * 8 // 9), False)] = pick.integers(1, 2**63, size - -(-size * 8 // 9), dtype=np.uint64)
        kmers += [one, other]
        first += [first[-1] + size, first[-1] + 2 * size]
    keys = near_dedup.sketches(np.concatenate(kmers), np.array(first))
    assert (keys[::2] == keys[1::2]).any(1).all()


def test_compared_kmers(spark):
    """What two texts have in common among the compared k-mers tells their similarity; exactly, if these are all."""
    pick = random.Random(4)
    for size in (60, 200, 1500):
        base = [f"w{pick.randrange(10**6)}" for _ in range(size)]
        other = [w if pick.random() > 0.02 else "new" + w for w in base]
        texts = [" ".join(base), " ".join(other)]
        prints = near_dedup._prints(near_dedup._kmer_lists(pa.array(texts)))
        common = near_dedup.in_common(prints, np.array([0]), np.array([1]))[0, 0]
        want = sum((Counter(kmers(texts[0])) & Counter(kmers(texts[1]))).values())
        scale = 2.0 ** near_dedup._level(np.array([size - 4]))[0]
        assert common == want if scale == 1 else abs(common * scale / want - 1) < 0.15


@pytest.mark.parametrize("size", [300, 520, 1030, 4000, 10_000])
def test_blocks_keep_every_pair_at_the_least_similarity(size):
    """Pairs of long texts that no leader joined: at 0.8 each is linked, below none is."""
    texts, n = [], size - 4
    for i in range(40 if size < 4000 else 12):
        base = [f"b{i}x{k}" for k in range(size)]
        new = n // 9 + (i % 2)
        texts += [" ".join(base), " ".join(base[: size - new] + [f"n{i}x{k}" for k in range(new)])]
    row = pa.array(range(len(texts)))
    group = pa.table({"low": [0] * len(texts), "high": [0] * len(texts), "block": [0] * len(texts), "row": row, "n": [n] * len(texts), "class": row, "text": texts})
    found = near_dedup._compared(group)
    assert sorted(found.column("v").to_pylist()) == list(range(0, len(texts), 4))


def test_common_kmers_are_counted_in_parts(monkeypatch):
    pick = np.random.default_rng(6)
    kmers = [pick.choice(4000, size).astype(np.uint64) for size in (700, 900, 3000, 2900)]
    kmers += [np.append(k[: len(k) * 19 // 20], np.arange(9000, 9000 + len(k) // 20)).astype(np.uint64) for k in kmers]
    one = two = np.arange(len(kmers))
    want = [[9 * sum((Counter(a.tolist()) & Counter(b.tolist())).values()) >= 4 * (len(a) + len(b)) for b in kmers] for a in kmers]
    for counted in (near_dedup.COUNTED, 1000):
        monkeypatch.setattr(near_dedup, "COUNTED", counted)
        assert near_dedup._sharing(kmers, one, two, np.ones((8, 8), bool)).tolist() == want


def test_short_texts_are_exact(spark):
    """Texts of few k-mers, with one or two words more or fewer at the ends or inside a run, by brute force."""
    pick, rows = random.Random(7), []
    for n in range(4, 15):
        for i in range(60):
            base = [f"s{n}x{i}x{k}" for k in range(n + 4)]
            if i % 3 == 0:
                base[2:8] = ["run"] * len(base[2:8])
            other = list(base)
            for _ in range(pick.randrange(1, 3)):
                at = pick.choice([0, len(other), 4])
                other[at:at] = ["run" if at == 4 else f"new{n}x{i}"]
            for w in (base, other, base[1:], base[:-1] + ["end"]):
                rows.append((len(rows), " ".join(w)))
    found = near_dedup.near_duplicates(table(spark, rows)).collect()
    by_group = {}
    for k, t in rows:
        by_group.setdefault(k // 4, []).append((k, t))
    want = []
    for some in by_group.values():
        want += partition([k for k, _ in some], classes(some))
    assert partition([r.doc_id for r in found], [r.class_id for r in found]) == sorted(want, key=str)


def test_order_matters(spark):
    first, second = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    found = near_dedup.near_duplicates(table(spark, [(1, f"{first} {second}"), (2, f"{second} {first}")])).collect()
    assert sorted(r.class_id for r in found) == [1, 2]


@pytest.mark.parametrize("seed", range(20))
def test_alignment(seed):
    pick = random.Random(seed)
    a = [pick.randrange(30) for _ in range(pick.randrange(1, 80))]
    b = [x for x in a if pick.random() > 0.06]
    for _ in range(pick.randrange(5)):
        b.insert(pick.randrange(len(b) + 1), pick.randrange(30))
    s = subsequence(a, b)
    near = bool(s) and 5 * s >= 4 * (len(a) + len(b) - s)
    assert near_dedup.aligned(a, b) == (s if near else None)


def test_odd_rows(spark):
    found = near_dedup.near_duplicates(table(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by = {}
    for r in found:
        by.setdefault(r.class_id, []).append(r)
    assert sorted(((k, len(v)) for k, v in by.items()), key=str) == [(1, 4), (3, 3), (5, 1), (6, 1), (7, 1)]
    assert all(sum(r.kept for r in v) == 1 and all(r.class_size == len(v) for r in v) for v in by.values())


def test_empty_table(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    assert near_dedup.drop_near_duplicates(table(spark, [])).count() == 0


def test_rows_that_stay_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in ODD], DOCS)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 6, 7]


def test_components(spark):
    pick = random.Random(3)
    links = [(pick.randrange(200), pick.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 450)]
    group = {}
    for u, v in links:
        if u != v:
            a, b = group.setdefault(u, {u}), group.setdefault(v, {v})
            if a is not b:
                a |= b
                group.update({x: a for x in b})
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: min(a) for x, a in group.items()}


def test_given_documents(spark):
    rows = [tuple(r) for r in queries.read(spark, DATA, "documents").select("doc_id", "text").collect()]
    found = queries.op8_near_dedup(spark, DATA).collect()
    assert partition([r.doc_id for r in found], [r.class_id for r in found]) == partition([k for k, _ in rows], classes(rows))
