import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest_llm import DATA, ODD, table
from pyspark.sql import functions as F

from fleetcatalog.llm import arrays, language_model, queries


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(key):
    return zlib.crc32(str(key).encode()) % 7 == 2


def check_base(rows, texts):
    """Counts and base scores by counting words in a dictionary."""
    counts = Counter(t for key, text in texts for t in tokens(text) if key is None or not held(key))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        ((key, key is not None and held(key), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(text))) for key, text in texts),
        key=str,
    )
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert {r.train_tokens for r in rows} <= {n}


def test_given_documents(spark):
    texts = [tuple(r) for r in queries.read(spark, DATA, "documents").select("doc_id", "text").collect()]
    rows = queries.op4_language_model(spark, DATA).collect()
    check_base(rows, texts)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_odd_rows(spark):
    rows = language_model.score(table(spark, ODD), queries.held_out("doc_id", 7, 2)).collect()
    check_base(rows, ODD)
    assert all(r.score < 0 for r in rows)
    assert language_model.score(table(spark, []), F.lit(False)).count() == 0


def test_nothing_to_learn_from(spark):
    rows = language_model.score(table(spark, ODD), F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)


def test_probabilities_add_up():
    """Over the classes after any history; and over a class's known words and one unknown one."""
    pick = np.random.default_rng(1)
    model = language_model.Model(np.zeros(0, np.uint64), pick.normal(size=language_model.CLASSES).astype(np.float32), pick.normal(size=(language_model.FEATURES, language_model.CLASSES)).astype(np.float32))
    x = pick.integers(0, language_model.FEATURES, (50, language_model.TEMPLATES)).astype(np.int32)
    each = [np.exp(language_model.log_classes(model, x, np.full(len(x), c))) for c in range(language_model.CLASSES)]
    assert np.allclose(np.sum(each, 0), 1, atol=1e-4)
    counts = [5, 1, 3]
    assert math.isclose(sum((c + 1) / (sum(counts) + len(counts) + 1) for c in [*counts, 0]), 1)


def test_gradient_lowers_the_loss():
    pick = np.random.default_rng(2)
    model = language_model.Model(np.zeros(0, np.uint64), np.zeros(language_model.CLASSES, np.float32), np.zeros((language_model.FEATURES, language_model.CLASSES), np.float32))
    x = pick.integers(0, 40, (4000, language_model.TEMPLATES)).astype(np.int32)
    y = x[:, 0] % language_model.CLASSES
    loss = lambda: -language_model.log_classes(model, x, y).mean()
    before, squares = loss(), np.zeros_like(model.weights)
    for at in range(0, len(y), 500):
        language_model.update(model, squares, x[at : at + 500], y[at : at + 500])
    assert loss() < 0.6 * before


def test_history_stays_in_its_document():
    words = arrays.seeds(7)
    classes, first = np.arange(7), np.array([0, 3, 3, 7])
    both = language_model.features(words, classes, first)
    alone = language_model.features(words[3:], classes[3:], np.array([0, 4]))
    assert np.array_equal(both[3:], alone)


def test_hashes_of_words_are_those_of_their_bytes():
    texts = ["Ab aB", "ab", "", " ab\tabc\n", "é É"]
    parts = []
    for limit in (1, 1 << 20):
        parts.append(np.concatenate([arrays.word_hashes(s, arrays.words(s)) for s in arrays.slices(pa.array(texts), limit)]))
    assert np.array_equal(*parts)
    first = parts[0]
    assert len(set(first[[0, 1, 2, 3]].tolist())) == 1 and len(set(first.tolist())) == 4


def many_blocks(spark):
    """Words of one block, of some and of all, in a block for each partition."""
    texts = [(i, " ".join(["all", *(f"some{i % k}" for k in (2, 3, 5)), f"One{i}", f"one{i}"] * (1 + i % 3))) for i in range(60)]
    return texts, table(spark, texts).repartition(12, "doc_id")


def test_counts_of_many_blocks(spark):
    texts, docs = many_blocks(spark)
    check_base(language_model.score(docs, queries.held_out("doc_id", 7, 2)).collect(), texts)


def test_score_without_histories(spark):
    """Without a round the classes have their shares, whatever went before."""
    texts, docs = many_blocks(spark)
    counts = Counter(t for key, text in texts for t in tokens(text) if not held(key))
    names = [t for t in counts if t is not None]
    found = arrays.slices(pa.array(names))
    hashes = dict(zip(names, np.concatenate([language_model._hashed(s)[0] for s in found]), strict=True))
    hashes[None] = np.uint64(language_model.END)
    top = sorted(names, key=lambda t: (-counts[t], int(hashes[t].view(np.int64))))[: language_model.FREQUENT]
    frequent = np.sort(np.array([hashes[t] for t in top], np.uint64))
    of_word = {t: int(language_model.classes_of(np.array([h], np.uint64), frequent)[0]) for t, h in hashes.items()}
    in_class, of_class = Counter(of_word.values()), Counter()
    for t, n in counts.items():
        of_class[of_word[t]] += n
    log = lambda t: math.log10((of_class[of_word[t]] + 1) / (counts.total() + language_model.CLASSES) * (counts[t] + 1) / (of_class[of_word[t]] + in_class[of_word[t]] + 1))
    want = {key: sum(map(log, tokens(text))) for key, text in texts if not held(key)}
    rows = language_model.score(docs, queries.held_out("doc_id", 7, 2), rounds=0).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r.score for r in rows if not r.held_out}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_blocks_words_are_shuffled_once_and_in_lists(spark):
    """To be counted; neither a row for each word of a block nor the lists go to the scores."""
    _, docs = many_blocks(spark)
    scored = language_model.score(docs, F.lit(False))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    left = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "words" not in left.split("[", 1)[1].split("]")[0]


def test_sums_in_a_bucket():
    """A row for each block with the sums of its words in its order, and one on what is known."""
    ending = np.arange(6, dtype=np.uint64) * np.uint64(32) + np.array([0, 1, 1, 2, 3, 3], np.uint64)
    words = np.append(ending, np.uint64(language_model.END)).view(np.int64).tolist()
    shares = [(1, [words[0], words[1], words[6]], [2, 0, 4]), (2, [words[2], words[1], words[0]], [1, 0, 5]), (3, [words[3], words[6]], [0, 3])]
    made = pa.table({"block": [b for b, _, _ in shares], "bucket": pa.array([4] * 3, pa.int32()), "words": [w for _, w, _ in shares], "learned": [n for _, _, n in shares]})
    *blocks, about = language_model._summed(pa.concat_tables([made.slice(0, 2), made.slice(2)])).to_pylist()
    assert [(r["of_block"], r["bucket"], r["n"], r["top"]) for r in blocks] == [(1, 4, [7, 0, 7], None), (2, 4, [1, 0, 7], None), (3, 4, [0, 7], None)]
    assert about["of_block"] is None and about["top"] == [words[0], words[2]] and about["n_of_top"] == [7, 1]
    assert about["n_by_ending"][:4] == [7, 7, 1, 0] and about["words_by_ending"][:4] == [1, 1, 1, 0] and sum(about["n_by_ending"]) == 15


def test_buckets_follow_the_hashes():
    words = np.sort(arrays.seeds(5000))
    for buckets in (1, 7, 1000):
        got = language_model.buckets_of(words, buckets)
        assert got.min() >= 0 and got.max() < buckets and (np.diff(got) >= 0).all() and np.bincount(got, minlength=buckets).max() < 5000 / buckets + 50


def plain_update(model, squares, x, y):
    logits = sum(model.weights[x[:, t]] for t in range(language_model.TEMPLATES)) + model.constant
    slope = np.exp(logits - logits.max(1, keepdims=True))
    slope /= slope.sum(1, keepdims=True)
    slope[np.arange(len(y)), y] -= 1
    flat = x.T.ravel()
    order = np.argsort(flat, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
    rows, total = flat[order[begin]], np.add.reduceat(slope[order % len(y)], begin, 0)
    squares[rows] += total * total
    model.weights[rows] -= language_model.RATE * total / np.sqrt(1 + squares[rows])


def batches_of_histories():
    """Features like those of words: few are frequent, many occur once or twice in a batch."""
    pick = np.random.default_rng(3)
    x = np.minimum(pick.zipf(1.3, (3, 8192, language_model.TEMPLATES)), 4000) + 4000 * np.arange(language_model.TEMPLATES)
    return x.astype(np.int32), pick.integers(0, language_model.CLASSES, (3, 8192))


def untrained():
    weights = np.zeros((language_model.FEATURES, language_model.CLASSES), np.float32)
    return language_model.Model(np.zeros(0, np.uint64), np.linspace(-1, 0, language_model.CLASSES, dtype=np.float32), weights), np.zeros_like(weights)


def test_update_is_the_plain_one():
    (model, squares), (plain, plain_squares) = untrained(), untrained()
    for x, y in zip(*batches_of_histories(), strict=True):
        for n in (len(y), 700, 1):
            language_model.update(model, squares, x[:n], y[:n])
            plain_update(plain, plain_squares, x[:n], y[:n])
    assert np.allclose(model.weights, plain.weights, atol=1e-6) and np.allclose(squares, plain_squares, rtol=1e-4)


def test_update_costs_less_than_the_plain_one():
    """Sums row by row take twice the time that the whole step may take."""
    x, y = (z[0] for z in batches_of_histories())

    def least(step):
        model, squares = untrained()
        took = []
        for _ in range(8):
            start = time.process_time()
            step(model, squares, x, y)
            took.append(time.process_time() - start)
        return min(took)

    assert least(language_model.update) < 0.8 * least(plain_update)


def test_histories_are_words_and_classes_before():
    pick = np.random.default_rng(4)
    words, classes = arrays.seeds(200), pick.integers(0, language_model.CLASSES, 200)
    first = np.array([0, 1, 1, 3, 60, 400])
    at = pick.integers(0, 200, 400).astype(np.uint32)
    got = language_model.histories(words, classes, at, first)
    m, start, size = [int(s) for s in arrays.seeds(4, 6000)], int(language_model.START), 1 << 64
    for doc in range(len(first) - 1):
        for i in range(first[doc], first[doc + 1]):
            back = [at[i - k] if i - k >= first[doc] else None for k in (1, 2, 3)]
            w = [start if b is None else int(words[b]) for b in back]
            c = [start if b is None else int(classes[b]) for b in back]
            hashed = [w[0] * m[0] + 1, c[0] * m[0] + c[1] * m[1] + 2, w[1] * m[2] + 3, c[0] * m[0] + c[1] * m[1] + c[2] * m[3] + 4]
            want = arrays.mixed(np.array([h % size for h in hashed], np.uint64)) % np.uint64(language_model.FEATURES)
            assert got[i].tolist() == want.tolist()
