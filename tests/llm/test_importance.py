import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD, as_in_sql, table
from pyspark.sql import functions as F

from fleetcatalog.llm import arrays, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, items, percent=25, least=20):
    """Rows of (doc_id, n_features, weight, score, rank) with zlib and dictionaries."""
    bucket = lambda run: zlib.crc32(run.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, items)):
        for text in texts:
            for run in runs(text)[1]:
                counts[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for key, text in docs:
        words, found = runs(text)
        weight = sum(gain[bucket(r)] for r in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {}
    for k, r in enumerate(order[: percent * len(order) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return sorted(((*r[:4], rank[r].pop() if rank.get(r) else None) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_checksums_of_spans_of_any_length():
    pick = np.random.default_rng(1)
    data = pick.integers(0, 256, 300_000).astype(np.uint8)
    size = np.concatenate([[0, 1, 63, 64, 65, 128, 129, 4096, 100_000, 300_000], pick.integers(0, 300, 5000), [0]])
    start = np.array([pick.integers(0, len(data) - n + 1) for n in size])
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size, strict=True)]
    assert importance.crc32_spans(data, start, start + size).tolist() == want
    assert importance.crc32_spans(data, start[:0], start[:0]).tolist() == []
    assert importance.crc32_spans(data, start[:1], start[:1]).tolist() == [0]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_stay_inside_their_text(longest):
    texts = ["A b  C", "", "one", "--", "é!É z" + "q" * 200 + " x"]
    found = {}
    for part in arrays.slices(pa.array(texts), 4):
        bucket, text, _ = importance.run_buckets(part, 1 << 31, longest)
        for b, t in zip(bucket.tolist(), (text + part.first).tolist(), strict=True):
            found.setdefault(t, []).append(b)
    for k, text in enumerate(texts):
        words = runs(text)[0]
        want = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        assert sorted(found.get(k, [])) == sorted(zlib.crc32(w.encode()) % (1 << 31) for w in want)


def test_odd_rows_against_a_plain_version(spark):
    pick = random.Random(2)
    long = [(100 + i, " ".join(pick.choice(["Sun", "moon", "star", "tide", "ebb", "x" * 90]) for _ in range(pick.randrange(15, 40)))) for i in range(60)]
    docs = [*ODD, *long, long[0], (100, long[1][1]), (None, long[2][1])]
    items = ["sun and moon and star", None, "", "tide"]
    target = table(spark, list(enumerate(items)), "item_id long, text string")
    assert got(importance.importance(table(spark, docs), target)) == plain(docs, items)
    assert got(importance.importance(table(spark, docs), target.limit(0))) == plain(docs, [])
    assert got(importance.importance(table(spark, docs), target, percent=100, least_words=0)) == plain(docs, items, 100, 0)
    assert importance.importance(table(spark, []), target).count() == 0


def test_drawn_rows_are_like_the_target_and_keep_their_columns(spark):
    pick = random.Random(3)
    text = lambda words: " ".join(pick.choice(words) for _ in range(60))
    near, far = ["tide", "wave", "shore", "salt"], ["bond", "loan", "rate", "yield"]
    docs = table(spark, [(i, text(near if i % 4 == 0 else far)) for i in range(200)])
    target = table(spark, [(i, text(near)) for i in range(20)], "item_id long, text string")
    drawn = importance.resample(docs, target)
    assert drawn.columns == docs.columns and drawn.where("row <> 7").count() == 0
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 50 and sum(i % 4 == 0 for i in ids) >= 45


def test_ranks_do_not_depend_on_the_partitions(spark, docs):
    target = spark.createDataFrame([(docs.first().text,)], "text string")
    one = got(importance.importance(docs.coalesce(1), target))
    assert one == got(importance.importance(docs.repartition(13, F.col("doc_id")), target))
    ranks = sorted(r[4] for r in one if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_given_documents_as_in_sql(spark):
    as_in_sql(spark, "op11_importance_resampling")
