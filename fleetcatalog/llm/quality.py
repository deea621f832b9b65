"""Operator 1, quality: histogram gradient-boosted trees over statistics of the text.

Statistics are numpy sums over the bytes of a batch. Trees grow level by level on binned features;
the finished ones are flat arrays (feature, threshold, children, value), and a batch goes down all
trees of one depth with one step of indexing.

The trees are fitted on a bounded sample of labelled rows, ``SAMPLE`` rows at most of those that
``learn`` allows, the first by a hash of the id. Everything else reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 60, 4, 0.15, 64, 20
KEEP_SCORE = 0.7

_LOWER = arrays.table(range(0x61, 0x7B))
_UPPER = arrays.table(range(0x41, 0x5B))
_DIGIT = arrays.table(range(0x30, 0x3A))
_SPACE = arrays.table(arrays.ASCII_SPACE)
_HIGH = arrays.table(range(0x80, 0x100))
_STOP = arrays.table(b".,;:?")
_SYMBOL = arrays.table({*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)} - {*b".,;:?"})
_LETTER = _LOWER | _UPPER | _HIGH
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "high", "stop", "symbol", "newline", "control",
    "log_words", "word_bytes", "long_words", "short_words", "symbol_ends", "stop_ends", "upper_starts",
    "no_letters", "distinct_words", "repeated_runs", "repeated_lines", "line_words",
)


def statistics(texts: arrays.Texts) -> np.ndarray:
    """[text, feature]; a text without bytes or words has zeros where nothing can be divided."""
    data, n = texts.data, len(texts)
    size = np.diff(texts.offsets).astype(float)
    share = lambda members: arrays.sums(members[data], texts.offsets) / np.maximum(size, 1)
    found = arrays.words(texts)
    count = np.diff(found.first).astype(float)
    per_word = lambda x: arrays.sums(x, found.first) / np.maximum(count, 1)
    length = (found.end - found.start).astype(float)
    last, first = data[found.end - 1], data[found.start]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has_letters = letters[found.end] - letters[found.start]
    hashes = arrays.word_hashes(texts, found)

    def distinct(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        group = np.repeat(np.arange(n), np.diff(bounds))
        order = np.lexsort((values, group))
        v, g = values[order], group[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
        return np.bincount(g[new], minlength=n) / np.maximum(np.diff(bounds), 1)

    runs, run_first = arrays.run_hashes(hashes, found.first, 3)
    lines = arrays.words(texts, ~arrays.table(b"\n"))
    line_hashes = arrays.word_hashes(texts, lines, fold=False)
    line_count = np.diff(lines.first)
    return np.stack(
        [
            np.log1p(size), share(_LOWER), share(_UPPER), share(_DIGIT), share(_SPACE), share(_HIGH), share(_STOP), share(_SYMBOL),
            share(arrays.table(b"\n")), share(arrays.table({*range(32)} - {*arrays.ASCII_SPACE})),
            np.log1p(count), per_word(length), per_word(length > 12), per_word(length < 3),
            per_word(_SYMBOL[last]), per_word(_STOP[last]), per_word(_UPPER[first]), per_word(has_letters == 0),
            distinct(hashes, found.first), 1 - distinct(runs, run_first), 1 - distinct(line_hashes, lines.first),
            count / np.maximum(line_count, 1),
        ],
        1,
    ).astype(np.float32)


class Trees(NamedTuple):
    """Nodes of all trees in rows: inner nodes send a row to ``left`` if its feature is at most ``threshold``, else to ``left`` + 1; leaves send to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST) -> Trees:
    """Trees for the log odds of y; each level's gradient histograms are one ``bincount`` over (node, feature, bin)."""
    n, width = x.shape
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, width), int)
    score = np.full(n, base)
    nodes = 2 ** (depth + 1) - 1
    feature, threshold = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf, np.float32)
    left, value = np.tile(np.arange(nodes), (trees, 1)), np.zeros((trees, nodes))
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth + 1):
            low, k = 2**level - 1, 2**level
            node = at - low
            mine = (node >= 0) & (node < k)
            rows = np.flatnonzero(mine)
            total_g, total_h = np.bincount(node[rows], g[rows], k), np.bincount(node[rows], h[rows], k)
            value[t, low : low + k] = -rate * total_g / (total_h + 1)
            if level == depth:
                break
            key = ((node[rows, None] * width + np.arange(width)) * BINS + binned[rows]).ravel()
            shape = (k, width, BINS)
            hist = [np.bincount(key, np.repeat(w[rows], width), k * width * BINS).reshape(shape).cumsum(2) for w in (g, h, np.ones(n))]
            left_g, left_h, left_n = (v[:, :, :-1] for v in hist)
            sum_g, sum_h, sum_n = (v[:, :, -1:] for v in hist)
            gain = left_g**2 / (left_h + 1) + (sum_g - left_g) ** 2 / (sum_h - left_h + 1) - sum_g**2 / (sum_h + 1)
            gain[(left_n < least) | (sum_n - left_n < least)] = -1
            best = gain.reshape(k, -1).argmax(1)
            for i in range(k):
                f, b = divmod(int(best[i]), BINS - 1)
                if gain[i, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, low + i], threshold[t, low + i], left[t, low + i] = f, edges[f][b], 2 * (low + i) + 1
            inner = rows[left[t, at[rows]] != at[rows]]
            right = x[inner, feature[t, at[inner]]] > threshold[t, at[inner]]
            at[inner] = left[t, at[inner]] + right
        score += value[t, at]
    start = np.arange(trees)[:, None] * nodes
    return Trees(feature.ravel(), threshold.ravel(), (left + start).ravel(), value.ravel(), base)


def predict(trees: Trees, x: np.ndarray, count: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """Probability of label 1: all rows go down all trees together."""
    at = np.tile(np.arange(count) * (2 ** (depth + 1) - 1), (len(x), 1))
    rows = np.arange(len(x))[:, None]
    for _ in range(depth):
        right = x[rows, trees.feature[at]] > trees.threshold[at]
        at = trees.left[at] + right
    return 1 / (1 + np.exp(-(trees.base + trees.value[at].sum(1))))


def _features_of(batch: pa.RecordBatch, text_at: int) -> np.ndarray:
    out = [statistics(texts) for texts in arrays.slices(batch.column(text_at).fill_null(""))]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)), np.float32)


def train(docs: DataFrame, labels: DataFrame, learn, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from the labelled documents that ``learn`` (a condition on doc_id) allows, ``sample`` of them at most.

    A document labelled several times counts once, with its smallest label; null ids and labels are left out.
    """
    marked = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn(F.col("doc_id")))
    picked = marked.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features_of(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    #: At most SAMPLE labels, of two numbers each, are broadcast, and at most SAMPLE rows of statistics come back for each copy of a document.
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("label", T.DoubleType()), T.StructField("x", T.ArrayType(T.FloatType()))]))
    got = rows.orderBy("doc_id").limit(sample).toArrow()
    x = np.array(got["x"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array(got["label"].to_pylist(), float))


def score(docs: DataFrame, trees: Trees, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each row; null texts count as empty, and an empty text has the score of its zero statistics."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = predict(model.value, _features_of(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, T.StructType([picked.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, trees: Trees, least: float = KEEP_SCORE, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    text_at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(predict(model.value, _features_of(batch, text_at)) >= least))

    return docs.mapInArrow(run, docs.schema)
