"""Operator 9, toxicity: nearest labelled examples by exact TF-IDF cosine, over block-max inverted indexes.

All words of the labelled examples are terms. A term weighs its inverse document frequency, counted over
all documents, times how well it tells the labels apart in the sample (chi-square beyond chance, as a share of
the best term's, plus ``LEAST_WEIGHT``), so no word is without weight. Examples with equal vectors are one entry with counts.
Entries stand in blocks, those with the same heaviest terms together; for each term the index has its postings by
block and the most it weighs in each. The few terms that are in very many entries have a whole row instead, and are added
up for many queries at once, so that their part of a bound is what they give. A query adds up bounds of blocks, opens blocks from the highest bound on, and
stops at the first bound below the last neighbour it needs, so that no nearer example is missed. Neighbours
vote with weights that fall with distance; leave-one-out votes of the examples, made monotone, calibrate
the scores.

The examples are a bounded sample of labelled rows, ``SAMPLE`` at most, the first by a hash of the id.
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

SAMPLE = 3_000
#: What a term weighs that tells nothing, as a share of the best one.
LEAST_WEIGHT = 0.01
NEIGHBOURS = 25
BLOCK = 64
#: Terms in this share of the entries or more have a row of weights; queries are multiplied with them QUERIES at once.
COMMON, QUERIES = 0.05, 256
#: Added to a neighbour's distance before it is inverted.
NEAR = 0.05
VOTE_COLUMNS = ["doc_id", "score", "raw", "similarity", "evidence"]


def _term_counts(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and count of each distinct word of each text, in that order; and a digest of each text's words."""
    found = arrays.words(texts, arrays.ALNUM)
    hashes = arrays.word_hashes(texts, found)
    order = np.lexsort((hashes, found.text))
    text, term = found.text[order], hashes[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    place = (np.arange(len(hashes)) - found.first[:-1][found.text]).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mixed(hashes + place * np.uint64(arrays.BASE)))])
    digest = total[found.first[1:]] - total[found.first[:-1]] + np.diff(found.first).astype(np.uint64)
    return text[begin], term[begin], np.diff(np.append(begin, len(term))), digest


class Index(NamedTuple):
    terms: np.ndarray  # sorted hashes
    scale: np.ndarray  # weight of each term
    entry_first: np.ndarray  # entry e has terms entry_first[e]:entry_first[e + 1]
    entry_term: np.ndarray
    entry_weight: np.ndarray
    common_at: np.ndarray  # row of each term in ``common``, or -1
    common: np.ndarray  # [row, entry] weights
    cell_first: np.ndarray  # any other term t has cells cell_first[t]:cell_first[t + 1], one for each block it is in
    cell_block: np.ndarray
    cell_most: np.ndarray  # the most it weighs there
    posting_first: np.ndarray  # cell c has postings posting_first[c]:posting_first[c + 1]
    posting_entry: np.ndarray
    posting_weight: np.ndarray
    rows: np.ndarray  # examples of entry e, and those of label 1
    toxic: np.ndarray
    ids: list
    none_rows: int  # examples without any term
    none_toxic: int
    raw: np.ndarray  # calibration: raw votes that rise, and the score of each
    score: np.ndarray


def term_weights(rarity: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """Weights of terms: ``rarity`` is all documents by those with the term; of ``chi`` counts what is above the largest value that chance gives so many terms."""
    above = np.maximum(chi - 2 * np.log(max(len(chi), 1)), 0)
    return (1 + np.log(rarity)) * (above / max(above.max(initial=0), 1e-12) + LEAST_WEIGHT)


def _weights(scale: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    w = (1 + np.log(count)) * scale[term]
    return w / np.sqrt((w * w).sum())


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of ``first[i]``, ``first[i] + 1`` ... one range of ``size[i]`` after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + size, size)


def common_parts(index: Index, query: np.ndarray, term: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """[query, entry]: what the common terms give, of ``count`` queries whose terms are listed with their number."""
    row = index.common_at[term]
    dense = np.zeros((count, len(index.common)))
    dense[query[row >= 0], row[row >= 0]] = weight[row >= 0]
    return dense @ index.common


def nearest(index: Index, term: np.ndarray, weight: np.ndarray, need: int = NEIGHBOURS, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The entries that hold the ``need`` nearest examples, ties of the last whole, with cosines; nearest first, ties by entry.

    ``part`` is what the common terms give to each entry, if it is known.
    """
    if part is None:
        part = common_parts(index, np.zeros(len(term), np.int64), term, weight, 1)[0]
    count = index.cell_first[term + 1] - index.cell_first[term]
    cell, share = _ranges(index.cell_first[term], count), np.repeat(weight, count)
    block = index.cell_block[cell]
    blocks = -(-len(part) // BLOCK)
    bounds = np.bincount(block, share * index.cell_most[cell], blocks)
    if blocks:
        bounds = bounds + np.maximum.reduceat(part, np.arange(0, len(part), BLOCK))
    entries, cosines, last = np.zeros(0, np.int64), np.zeros(0), -1.0
    order = np.argsort(-bounds, kind="stable")
    step, at = 4, 0
    while at < len(order) and bounds[order[at]] > 0 and bounds[order[at]] >= last - 1e-12:
        opened = order[at : at + step]
        opened = opened[(bounds[opened] > 0) & (bounds[opened] >= last - 1e-12)]
        at, step = at + step, step * 2
        of = np.zeros(blocks, bool)
        of[opened] = True
        some = of[block]
        first = index.posting_first[cell[some]]
        size = index.posting_first[cell[some] + 1] - first
        posting = _ranges(first, size)
        rest = np.bincount(index.posting_entry[posting], np.repeat(share[some], size) * index.posting_weight[posting], len(part))
        inside = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        inside = inside[inside < len(part)]
        score = np.round(rest[inside] + part[inside], 12)
        entries, cosines = np.concatenate([entries, inside[score > 0]]), np.concatenate([cosines, score[score > 0]])
        sort = np.lexsort((entries, -cosines))
        entries, cosines = entries[sort], cosines[sort]
        enough = int(np.searchsorted(np.cumsum(index.rows[entries]), need))
        if enough < len(entries):
            last = cosines[enough]
            kept = cosines >= last
            entries, cosines = entries[kept], cosines[kept]
    return entries, cosines


def vote(index: Index, entries: np.ndarray, cosines: np.ndarray, left_out: tuple[int, float] | None = None) -> float:
    """Share of label 1 among the neighbours, each weighed by 1 / (distance + NEAR); ``left_out``: one example of that entry, of that label, doesn't count."""
    rows, toxic = index.rows[entries].astype(float), index.toxic[entries].astype(float)
    if left_out:
        rows[entries == left_out[0]] -= 1
        toxic[entries == left_out[0]] -= left_out[1]
    w = 1 / (1 - cosines + NEAR)
    return float((w * toxic).sum() / max((w * rows).sum(), 1e-12))


def _rising(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours; each pool smoothed by half an example of either label."""
    pools: list[list[float]] = []
    for x in np.unique(raw):
        at = raw == x
        pools.append([float(weight[at].sum()), float((weight * label)[at].sum()), x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, y, x1 = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + y, x1]
    return np.array([p[2] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[0] + 1) for p in pools])


def build_index(terms: np.ndarray, scale: np.ndarray, examples: list[tuple], common: float = COMMON) -> Index:
    """``examples``: (id, label, term numbers, counts), terms rising. ``common``: see COMMON."""
    groups: dict[tuple, list] = {}
    none = [0, 0]
    for key, label, term, count in examples:
        if not len(term):
            none[0] += 1
            none[1] += int(label)
            continue
        group = groups.setdefault((tuple(term), tuple(count)), [0, 0, key])
        group[0] += 1
        group[1] += int(label)
        group[2] = min(group[2], key)

    def heaviest(group: tuple) -> tuple:
        term, count = (np.array(x) for x in group)
        by_weight = np.lexsort((term, -(1 + np.log(count)) * scale[term]))
        return tuple(term[by_weight[:8]].tolist()), group

    order = sorted(groups, key=heaviest)
    weights = [_weights(scale, np.array(t), np.array(c, float)) for t, c in order]
    sizes = [len(t) for t, _ in order]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    term = np.concatenate([np.array(t, np.int64) for t, _ in order]) if order else np.zeros(0, np.int64)
    weight = np.concatenate(weights) if order else np.zeros(0)
    entry = np.repeat(np.arange(len(order)), sizes)
    often = np.bincount(term, minlength=len(terms)) >= max(common * len(order), 1)
    common_at = np.where(often, np.cumsum(often) - 1, -1)
    rows_of = np.zeros((int(often.sum()), len(order)))
    rows_of[common_at[term[often[term]]], entry[often[term]]] = weight[often[term]]
    by_term = np.argsort(term, kind="stable")
    by_term = by_term[~often[term[by_term]]]
    blocks = max(1, -(-len(order) // BLOCK))
    cells, posting_first = np.unique(term[by_term] * blocks + entry[by_term] // BLOCK, return_index=True)
    most = np.maximum.reduceat(weight[by_term], posting_first) if len(cells) else np.zeros(0)
    rows, toxic = (np.array([groups[k][i] for k in order], np.int64) for i in range(2))
    index = Index(
        terms, scale, first, term, weight, common_at, rows_of, np.searchsorted(cells, np.arange(len(terms) + 1) * blocks), cells % blocks, most,
        np.append(posting_first, len(by_term)), entry[by_term], weight[by_term], rows, toxic, [groups[k][2] for k in order], none[0], none[1], np.zeros(0), np.zeros(0),
    )
    raw, label, amount = [], [], []
    for some in range(0, len(order), QUERIES):
        last = min(some + QUERIES, len(order))
        mine = slice(first[some], first[last])
        parts = common_parts(index, entry[mine] - some, term[mine], weight[mine], last - some)
        for e in range(some, last):
            found = nearest(index, term[first[e] : first[e + 1]], weight[first[e] : first[e + 1]], NEIGHBOURS + 1, parts[e - some])
            for y, n in ((1, toxic[e]), (0, rows[e] - toxic[e])):
                if n:
                    raw.append(vote(index, *found, (e, y)))
                    label.append(y)
                    amount.append(n)
    pools = _rising(np.round(np.array(raw), 9), np.array(label, float), np.array(amount, float)) if raw else (np.zeros(0), np.zeros(0))
    return index._replace(raw=pools[0], score=pools[1])


def calibrated(index: Index, raw: float) -> float:
    """The score of the raw vote, on straight lines between the pools."""
    return float(np.interp(raw, index.raw, index.score)) if len(index.raw) else raw


def _document_counts(texts: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each term; a task adds up its own before anything is shuffled."""
    held = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rows = held.value, 0
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for part in arrays.slices(batch.column(0).fill_null("")):
                term = _term_counts(part)[1]
                place = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                total += np.bincount(place[terms[place] == term], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], names=["term", "n"])

    got = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    number, n = got["term"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(len(terms), np.int64)
    out[number[number >= 0]] = n[number >= 0]
    return int(n[number < 0].sum()), out


def train(docs: DataFrame, labels: DataFrame, learn, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Index:
    """The index of the labelled documents that ``learn`` (a condition on doc_id) allows, ``sample`` at most.

    A document labelled several times counts once, as 1 if any label is; null ids and labels are left out.
    Of examples with the same words, as of repeated rows, the one with the smallest id counts. Ids keep their type. A
    very long text is an example like any other; the words of the examples come to the driver.
    """
    marked = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn(F.col("doc_id")))
    picked = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in arrays.slices(batch.column(1).fill_null("")):
                text, term, count, digest = _term_counts(texts)
                first = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
                part = batch.slice(texts.first, len(texts))
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (term.view(np.int64), count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digest.view(np.int64)), *lists], names=["doc_id", "label", "digest", "terms", "counts"])

    many = T.ArrayType(T.LongType())
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("label", T.IntegerType()), T.StructField("digest", T.LongType()), T.StructField("terms", many), T.StructField("counts", many)])
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = texts.join(F.broadcast(picked.select(F.col("doc_id").cast(kind).alias("doc_id"), "label")), "doc_id").select("doc_id", "text", "label").mapInArrow(run, schema)
    least = F.min_by(F.struct("label", "terms", "counts"), F.col("doc_id")).alias("x")
    single = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), least).select("doc_id", "x.*").orderBy("doc_id").toArrow()
    label_of = single["label"].to_numpy()
    each = [np.asarray(x, np.int64).view(np.uint64) for x in single["terms"].to_pylist()]
    size = np.array([len(x) for x in each], np.int64)
    every = np.concatenate(each) if each else np.zeros(0, np.uint64)
    terms, number = np.unique(every, return_inverse=True)
    n, toxic, owner = len(label_of), int(label_of.sum()), np.repeat(label_of, size)
    having, bad = np.bincount(number, minlength=len(terms)), np.bincount(number[owner > 0], minlength=len(terms))
    off = bad * float(n) - having * float(toxic)
    chi = off * off * n / np.maximum(having * (n - having) * float(toxic) * (n - toxic), 1)
    documents, known = _document_counts(texts, terms) if len(terms) else (0, having)
    scale = term_weights(max(documents, 1) / np.maximum(known, 1), chi)
    #: At most SAMPLE examples, with the words of their texts.
    numbers = np.split(number, np.cumsum(size)[:-1]) if n else []
    examples = list(zip(single["doc_id"].to_pylist(), label_of.tolist(), (x.tolist() for x in numbers), single["counts"].to_pylist(), strict=True))
    return build_index(terms, scale, examples)


def score(docs: DataFrame, index: Index, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), raw vote, similarity of the nearest example, and evidence: ids of up to three nearest examples.

    Repeated rows each get a row; a very long text is one query. A text without any term, as an empty or null one, has the share of label 1 among such examples; its raw vote, similarity and evidence are null or empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        none = (index.none_toxic + 0.5) / (index.none_rows + 1)
        for batch in batches:
            out: list[tuple] = [(none, None, None, [])] * batch.num_rows
            for texts in arrays.slices(batch.column(1).fill_null("")):
                if not len(index.terms):
                    continue
                found = arrays.words(texts, arrays.ALNUM)
                hashes = arrays.word_hashes(texts, found)
                place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
                some = index.terms[place] == hashes
                pairs, counts = np.unique(found.text[some] * len(index.terms) + place[some], return_counts=True)
                text, term = np.divmod(pairs, len(index.terms))
                starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(text))
                weight = (1 + np.log(counts)) * index.scale[term]
                weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, starts)), ends - starts) if len(starts) else 1
                for some in range(0, len(starts), QUERIES):
                    first, last = starts[some : some + QUERIES], ends[some : some + QUERIES]
                    inner = slice(first[0], last[-1])
                    parts = common_parts(index, np.repeat(np.arange(len(first)), last - first), term[inner], weight[inner], len(first))
                    for i, j, part in zip(first, last, parts, strict=True):
                        entries, cosines = nearest(index, term[i:j], weight[i:j], part=part)
                        if len(entries):
                            raw = vote(index, entries, cosines)
                            out[texts.first + int(text[i])] = (calibrated(index, raw), raw, float(cosines[0]), [index.ids[e] for e in entries[:3]])
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.list_(batch.schema.field(0).type)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=VOTE_COLUMNS)

    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    doubles = [T.StructField(n, T.DoubleType()) for n in VOTE_COLUMNS[1:4]]
    return picked.mapInArrow(run, T.StructType([picked.schema["doc_id"], *doubles, T.StructField("evidence", T.ArrayType(picked.schema["doc_id"].dataType))]))
