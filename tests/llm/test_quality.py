import zlib

import numpy as np
import pyarrow as pa
from conftest_llm import DOCS, ODD, table

from fleetcatalog.llm import arrays, quality, queries
from fleetcatalog.llm.store import held_out

LARGER = "/root/testdata/sf0.01"


def walked(trees, x):
    """Each row down each tree by itself."""
    size, out = 2 ** (quality.DEPTH + 1) - 1, []
    for row in x:
        total = trees.base
        for t in range(quality.TREES):
            at = t * size
            while trees.left[at] != at:
                at = trees.left[at] + int(row[trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_flat_trees_say_what_walking_says():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x, y)
    assert np.allclose(quality.predict(trees, x[:50]), walked(trees, x[:50]))
    assert ((quality.predict(trees, x) > 0.5) == y).mean() > 0.95


def test_one_label_or_no_row():
    x = np.zeros((3, 2), np.float32)
    assert (quality.predict(quality.fit(x, np.ones(3)), x) > 0.5).all()
    assert np.allclose(quality.predict(quality.fit(x[:0], np.zeros(0)), x), 0.5)


def test_statistics_of_small_texts():
    texts = next(arrays.slices(pa.array(["", "Ab, 12\nAb, 12", "ééé $$$", "a a a a"])))
    x = dict(zip(quality.FEATURES, quality.statistics(texts).T, strict=True))
    assert np.isfinite(np.array(list(x.values()))).all()
    assert np.allclose(x["upper"], [0, 2 / 13, 0, 0])
    assert np.allclose(np.expm1(x["log_words"]), [0, 4, 2, 4], atol=1e-5)
    assert np.allclose(x["distinct_words"], [0, 0.5, 1, 0.25])
    assert np.allclose(x["repeated_lines"], [1, 0.5, 0, 0])
    assert np.allclose(x["symbol_ends"], [0, 0, 0.5, 0])


def test_slices_do_not_matter():
    texts = [t or "" for _, t in ODD]
    whole = quality.statistics(next(arrays.slices(pa.array(texts), 1 << 40)))
    parts = np.concatenate([quality.statistics(s) for s in arrays.slices(pa.array(texts), 10)])
    assert np.array_equal(whole, parts)


def test_held_out_labels_are_met(spark):
    docs, labels = queries.read(spark, LARGER, "documents"), queries.read(spark, LARGER, "labels")
    rows = queries.op1_quality(spark, LARGER).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    kept = quality.keep_good(docs, quality.train(docs, labels, lambda i: ~held_out(i, 4, 2)))
    assert kept.schema == docs.schema
    good = {r.doc_id for r in queries.op1_quality(spark, LARGER).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == good


def test_odd_rows(spark):
    docs = table(spark, ODD)
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 1), (99, 0)], "doc_id long, quality int")
    trees = quality.train(docs, marks, lambda i: i.isNotNull())
    rows = quality.score(docs, trees).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ODD), key=str)
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.score(table(spark, []), trees).count() == 0
    assert quality.train(table(spark, []), marks.limit(0), lambda i: i.isNotNull()).base == 0
    assert quality.keep_good(spark.createDataFrame([], DOCS), trees).count() == 0
