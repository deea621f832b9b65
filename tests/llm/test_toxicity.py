import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import DATA, ODD, table

from fleetcatalog.llm import queries, toxicity

LARGER = "/root/testdata/sf0.01"


def index(seed, count=700, terms=12, common=toxicity.COMMON):
    pick = np.random.default_rng(seed)
    idf = 1 + pick.random(terms) * 3
    examples = []
    for i in range(count):
        some = np.flatnonzero(pick.random(terms) < 0.25)
        examples.append((i, int(pick.random() < 0.2 + 0.6 * (0 in some)), tuple(some.tolist()), tuple(pick.integers(1, 4, len(some)).tolist())))
    return toxicity.build_index(np.arange(terms, dtype=np.uint64), idf, examples, common)


@pytest.mark.parametrize("common", [0.0, 0.25, 2.0])
def test_no_nearer_example_is_missed(common):
    """With rows for all terms, for some, and for none."""
    made = index(1, common=common)
    assert len(made.rows) > 3 * toxicity.BLOCK and (common == 0.25) == (0 < len(made.common) < 12)
    dense = np.zeros((len(made.rows), len(made.scale)))
    for e in range(len(made.rows)):
        i, j = made.entry_first[e : e + 2]
        dense[e, made.entry_term[i:j]] = made.entry_weight[i:j]
    pick = np.random.default_rng(2)
    for _ in range(60):
        term = np.flatnonzero(pick.random(len(made.scale)) < 0.3)
        if not len(term):
            continue
        weight = toxicity._weights(made.scale, term, pick.integers(1, 4, len(term)).astype(float))
        cosine = np.round(dense[:, term] @ weight, 12)
        order = np.lexsort((np.arange(len(cosine)), -cosine))
        order = order[cosine[order] > 0]
        last = cosine[order[min(np.searchsorted(np.cumsum(made.rows[order]), toxicity.NEIGHBOURS), len(order) - 1)]]
        want = [e for e in order if cosine[e] >= last - 1e-9]
        entries, cosines = toxicity.nearest(made, term, weight)
        assert set(entries) == set(want)
        assert np.allclose(cosines, cosine[entries], atol=1e-9)


def test_scores_rise_with_votes():
    made = index(3)
    assert (np.diff(made.raw) > 0).all() and (np.diff(made.score) >= 0).all() and made.score[-1] > made.score[0]
    assert 0 < made.score.min() and made.score.max() < 1


def test_held_out_labels_are_met(spark):
    labels = queries.read(spark, LARGER, "labels")
    rows = queries.op9_toxicity(spark, LARGER).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95


def test_whole_query_against_dense_vectors(spark):
    """All words, document frequencies, weights, neighbours, votes and calibration again, with one dense matrix."""
    docs = {r.doc_id: r.text or "" for r in queries.read(spark, DATA, "documents").collect()}
    marks = {r.doc_id: r.toxic for r in queries.read(spark, DATA, "labels").collect()}
    words = {i: Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for i, t in docs.items()}
    plain = {i: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for i, t in docs.items()}
    examples = {}
    for i in sorted(i for i in marks if i in docs and marks[i] is not None and zlib.crc32(str(i).encode()) % 5):
        examples.setdefault(plain[i], i)
    ids = sorted(examples.values())
    terms = sorted({w for i in ids for w in words[i]})
    at = {w: k for k, w in enumerate(terms)}
    label = np.array([marks[i] for i in ids])
    has = np.array([[w in words[i] for w in terms] for i in ids])
    a, t, n, p = has.sum(0), has[label == 1].sum(0), len(ids), label.sum()
    chi = (t * n - a * p) ** 2 * float(n) / np.maximum(a * (n - a) * float(p) * (n - p), 1)
    known = Counter(w for c in words.values() for w in c)
    above = np.maximum(chi - 2 * np.log(len(terms)), 0)
    scale = (1 + np.log(len(docs) / np.array([known[w] for w in terms]))) * (above / max(above.max(), 1e-12) + toxicity.LEAST_WEIGHT)

    def vector(i):
        v = np.zeros(len(terms))
        for w, c in words[i].items():
            if w in at:
                v[at[w]] = (1 + np.log(c)) * scale[at[w]]
        return v / max(np.sqrt(v @ v), 1e-12)

    matrix = np.stack([vector(i) for i in ids])

    def raw(v, need, left_out=None):
        cosine = np.round(matrix @ v, 12)
        order = np.argsort(-cosine, kind="stable")
        last = cosine[order[min(need, len(order)) - 1]]
        near = [k for k in order if cosine[k] > 0 and cosine[k] >= last - 1e-12 and k != left_out]
        w = 1 / (1 - cosine[near] + toxicity.NEAR)
        return (w * label[near]).sum() / w.sum() if len(near) else 0.0

    pools = toxicity._rising(np.round([raw(matrix[k], toxicity.NEIGHBOURS + 1, k) for k in range(n) if matrix[k].any()], 9), label[matrix.any(1)].astype(float), np.ones(int(matrix.any(1).sum())))
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, DATA).collect()}
    assert set(got) == set(docs)
    far = 0
    for i in docs:
        v = vector(i)
        if np.round(matrix @ v, 12).max() > 0:
            far += abs(np.interp(raw(v, toxicity.NEIGHBOURS), *pools) - got[i].score) > 1e-6
    assert far <= len(docs) // 100
    assert sum(not r.evidence for r in got.values()) < 0.05 * len(docs)


def test_ids_that_are_text(spark):
    docs = table(spark, [(f"d{i}", f"word {'bad' if i % 2 else 'good'} x{i}") for i in range(40)], "doc_id string, text string")
    made = toxicity.train(docs, spark.createDataFrame([(f"d{i}", i % 2) for i in range(30)], "doc_id string, toxic int"), lambda i: i.isNotNull())
    rows = toxicity.score(docs, made).collect()
    assert all((r.score > 0.5) == (int(r.doc_id[1:]) % 2 == 1) and set(r.evidence) <= {f"d{i}" for i in range(30)} for r in rows)


def test_odd_rows(spark):
    docs = table(spark, ODD + [(i, f"word x {'bad' if i % 2 else 'good'}") for i in range(100, 130)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(100, 130)] + [(100, None), (None, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    made = toxicity.train(docs, marks, lambda i: i.isNotNull())
    rows = toxicity.score(docs, made).collect()
    assert len(rows) == len(ODD) + 30 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.similarity is None and r.evidence == [] for r in rows if r.doc_id in (3, 4))
    assert toxicity.score(table(spark, []), made).count() == 0
    nothing = toxicity.train(docs, marks.limit(0), lambda i: i.isNotNull())
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
