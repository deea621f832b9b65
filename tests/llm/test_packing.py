import random

import pytest
from conftest_llm import DATA, ODD, table

from fleetcatalog.llm import packing, queries


def plain_best_fit(lengths, sizes, overhead):
    """The same choice by looking at every bin and every piece to come."""
    rate = min((s + overhead) / s for s in sizes)
    room, bins = [], []
    for k, n in enumerate(lengths):
        open_ = [(r, i) for i, r in enumerate(room) if r >= n]
        if open_:
            _, i = min(open_)
        else:
            left = sum(r for r in room if r > 0)

            def cost(s):
                fits = sum(x for x in lengths[k + 1 :] if x <= s - n)
                return s + overhead - rate * min(s - n, max(0, fits - left))

            room.append(min((s for s in sizes if s >= n), key=lambda s: (cost(s), s)))
            i = len(room) - 1
        room[i] -= n
        bins.append(i)
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_against_a_plain_version(seed):
    pick = random.Random(seed)
    lengths = sorted((pick.randrange(1, pick.choice([20, 101])) for _ in range(150)), reverse=True)
    bins, offsets, final = packing.best_fit(lengths, (30, 60, 100), 5)
    assert bins == plain_best_fit(lengths, (30, 60, 100), 5)
    filled = [0] * len(final)
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        assert o == filled[b]
        filled[b] += n
    assert final == [min(s for s in (30, 60, 100) if s >= f) for f in filled]


def whole(pieces, lengths, sizes):
    """Every token of every document once; no bin over its size, none overlapping, none larger than need be."""
    docs, bins = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append((p.start, p.length))
        bins.setdefault((p.bin_id, p.bin_size), []).append((p.bin_offset, p.length))
    assert len(bins) == len({b for b, _ in bins})
    for key, n in lengths.items():
        at = 0
        for start, length in sorted(docs.pop(key)):
            assert start == at
            at += length
        assert at == n
    assert not docs
    for (_, size), content in bins.items():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert size == min(s for s in sizes if s >= at)


def test_nothing_is_lost(spark):
    pick = random.Random(1)
    rows = [(i, i, pick.choice([1, 7, 100, 100, 250, 1000])) for i in range(700)]
    out = packing.pack(spark.createDataFrame(rows, "row long, doc_id long, n_tokens long"), (32, 128, 256), shard_rows=100)
    whole(out.collect(), {i: n for i, _, n in rows}, (32, 128, 256))


def test_given_documents(spark):
    lengths = {r.doc_id: r.n_tokens for r in packing.token_counts(queries.read(spark, DATA, "documents")).collect()}
    texts = {r.doc_id: len(r.text.split()) + 1 for r in queries.read(spark, DATA, "documents").collect() if r.text.isascii()}
    assert texts and all(lengths[k] == n for k, n in texts.items())
    out = queries.op3_packing(spark, DATA).collect()
    whole(out, lengths, packing.SIZES)
    assert sum(lengths.values()) > 0.9 * sum({p.bin_id: p.bin_size for p in out}.values())


def test_odd_rows(spark):
    out = packing.pack(packing.token_counts(table(spark, ODD))).collect()
    tokens = {}
    for p in out:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens == {1: 8, 2: 16, 3: 1, 4: 1, None: 9, 5: 60_001, 6: 2, 7: 2}
    assert packing.pack(packing.token_counts(table(spark, []))).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 1, None), (2, 2, 0)], "row long, doc_id long, n_tokens long")).count() == 0


def test_ids_keep_their_value_beside_null(spark):
    """A float has no room for these."""
    large = [9007199254740993, 9007199254740995, None, -9223372036854775808]
    out = packing.pack(packing.token_counts(table(spark, [(i, "a b c") for i in large])))
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(large, key=str)
    out = packing.pack(packing.token_counts(table(spark, [("x", "a b"), (None, "a"), ("y", "a " * 5000)], "doc_id string, text string")))
    assert sorted(((r.doc_id, r.length) for r in out.collect()), key=str) == [("x", 3), ("y", 4096), ("y", 905), (None, 2)]
