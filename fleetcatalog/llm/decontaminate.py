"""Operator 7, benchmark decontamination: every test suffix is looked up in suffix arrays of the documents.

The documents are cut into shards (slices of whole texts). A shard's suffix array holds the start
of every suffix that could begin with a test window, sorted by its first ``WINDOW`` words; a word
that no test item has ends a suffix, so most starts need no place in it. All test suffixes are
searched in it at once, each as the window it begins with, by binary search for the range of equal
beginnings. Neighbouring windows on one diagonal join to the longest verbatim match.

The test items are dealt over blocks of up to ``BLOCK_WORDS`` words. Tasks build the blocks and write
them down; one after the other is broadcast, and the documents are read once for each. With one block,
as usual, nothing of the documents is shuffled; with several, only what was found is, by row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import running_total
from . import arrays
from .store import free_name, keep

WINDOW = 13
#: Words of test items in one broadcast: about 150 bytes each, so 75 MB at most.
BLOCK_WORDS = 500_000
SHARD_BYTES = 4 << 20
FOUND = T.StructType(
    [
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_at", T.LongType()),
        T.StructField("longest_item", T.StringType()),
        T.StructField("n_words", T.LongType()),
    ]
)
FOUND_KIND = pa.struct([("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()), ("n_words", pa.int64())])
CARRIED = "matches"


class Block(NamedTuple):
    """Test windows, each distinct one once, as packed word numbers; where they stand in the items."""

    vocabulary: np.ndarray  # sorted hashes of all words of the block; word number 1 is the first
    low: np.ndarray  # [window, key]
    high: np.ndarray
    length: np.ndarray
    owner_first: np.ndarray  # owners of window w: owner_first[w]:owner_first[w + 1]
    owner_item: np.ndarray
    owner_at: np.ndarray
    ids: list


def _packing(vocabulary: int) -> tuple[int, int, int]:
    """Bits a word, words a key, keys a window."""
    bits = max(1, int(vocabulary + 1).bit_length())
    per_key = 63 // bits
    return bits, per_key, -(-WINDOW // per_key)


def _packed(numbers: np.ndarray, vocabulary: int) -> np.ndarray:
    """[n, WINDOW] word numbers as [n, keys] integers of the same order."""
    bits, per_key, keys = _packing(vocabulary)
    out = np.zeros((len(numbers), keys), np.int64)
    for j in range(keys * per_key):
        out[:, j // per_key] = (out[:, j // per_key] << bits) | (numbers[:, j] if j < WINDOW else 0)
    return out


def build_block(items: list[tuple[str | None, str]]) -> Block | None:
    """The windows of (id, text) items; None if no item has a word."""
    texts = next(arrays.slices(pa.array([t for _, t in items], pa.large_string()), 1 << 62))
    found = arrays.words(texts, arrays.ALNUM)
    if not len(found.start):
        return None
    vocabulary, numbers = np.unique(arrays.word_hashes(texts, found), return_inverse=True)
    numbers = np.concatenate([numbers + 1, np.zeros(WINDOW, np.int64)])
    counts = np.diff(found.first)
    per_item = np.where(counts >= WINDOW, counts - WINDOW + 1, np.minimum(counts, 1))
    item = np.repeat(np.arange(len(items)), per_item)
    at = np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item, per_item)
    length = np.minimum(np.repeat(counts, per_item), WINDOW)
    steps = np.arange(WINDOW)
    window = numbers[(found.first[:-1][item] + at)[:, None] + steps]
    window[steps >= length[:, None]] = 0
    distinct, which = np.unique(window, axis=0, return_inverse=True)
    order = np.argsort(which, kind="stable")
    lengths = np.zeros(len(distinct), np.int64)
    lengths[which] = length
    top = distinct.copy()
    top[steps >= lengths[:, None]] = len(vocabulary) + 1
    return Block(
        vocabulary,
        _packed(distinct, len(vocabulary)),
        _packed(top, len(vocabulary)),
        lengths,
        np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(distinct)))]),
        item[order],
        at[order],
        [i for i, _ in items],
    )


def _search(suffixes: np.ndarray, keys: np.ndarray, after: bool) -> np.ndarray:
    """For each key the number of sorted suffixes below it, or with ``after`` of those not above it; a bisection of all keys at once."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(suffixes))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        other = suffixes[np.minimum(middle, len(suffixes) - 1)]
        less, equal = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for j in range(keys.shape[1]):
            less |= equal & (other[:, j] < keys[:, j])
            equal &= other[:, j] == keys[:, j]
        right = open_ & (less | (equal if after else False))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


class Hit(NamedTuple):
    spans: list  # start, end, start, end ... in words of the document
    items: list
    longest: int
    longest_at: int
    longest_item: str | None


def match_slice(texts: arrays.Texts, block: Block) -> tuple[np.ndarray, dict[int, Hit]]:
    """Words of each text, and what was found in those with a hit, by text."""
    found = arrays.words(texts, arrays.ALNUM)
    counts = np.diff(found.first)
    if not len(found.start):
        return counts, {}
    hashes = arrays.word_hashes(texts, found)
    place = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    numbers = np.where(block.vocabulary[place] == hashes, place + 1, 0)
    known = np.flatnonzero(numbers)
    unknown = np.append(np.flatnonzero(numbers == 0), len(numbers))
    run = np.minimum(unknown[np.searchsorted(unknown, known)], found.first[found.text[known] + 1]) - known
    start = known[run >= block.length.min()]
    if not len(start):
        return counts, {}
    run = run[run >= block.length.min()]
    steps = np.arange(WINDOW)
    words = np.concatenate([numbers, np.zeros(WINDOW, numbers.dtype)])[start[:, None] + steps]
    words[steps >= run[:, None]] = 0
    keys = _packed(words, len(block.vocabulary))
    suffix_array = np.lexsort(keys.T[::-1])
    keys = keys[suffix_array]
    first, last = _search(keys, block.low, False), _search(keys, block.high, True)
    each = last - first
    window = np.repeat(np.arange(len(each)), each)
    if not len(window):
        return counts, {}
    at = start[suffix_array[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)]]

    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + block.length[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge_before = np.concatenate([[False], hit[:-1]])
    edge_before[found.first[:-1][counts > 0]] = False
    edge_after = np.concatenate([hit[1:], [False]])
    edge_after[found.first[1:][counts > 0] - 1] = False
    span_start, span_end = np.flatnonzero(hit & ~edge_before), np.flatnonzero(hit & ~edge_after) + 1

    owners = np.diff(block.owner_first)[window]
    owner = np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners) + np.repeat(block.owner_first[window], owners)
    at, window = np.repeat(at, owners), np.repeat(window, owners)
    item, length = block.owner_item[owner], block.length[window]
    diagonal = at - block.owner_at[owner]
    order = np.lexsort((at, diagonal, item))
    at, item, diagonal, length = at[order], item[order], diagonal[order], length[order]
    fresh = np.ones(len(at), bool)
    text = found.text[at]
    fresh[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(at)) - 1
    size = at[end] + length[end] - at[begin]

    hits = {}
    order = np.lexsort((item[begin], at[begin], -size, text[begin]))
    begin, size = begin[order], size[order]
    owner_text = text[begin]
    bounds = np.flatnonzero(np.append(True, owner_text[1:] != owner_text[:-1]))
    span_text = found.text[span_start]
    for k, i in enumerate(bounds):
        j = bounds[k + 1] if k + 1 < len(bounds) else len(begin)
        t = int(owner_text[i])
        base = found.first[t]
        s, e = np.searchsorted(span_text, t), np.searchsorted(span_text, t, "right")
        spans = np.stack([span_start[s:e] - base, span_end[s:e] - base], 1).ravel().tolist()
        named = sorted({block.ids[x] for x in np.unique(item[begin[i:j]]) if block.ids[x] is not None})
        hits[t] = Hit(spans, named, int(size[i]), int(at[begin[i]] - base), block.ids[item[begin[i]]])
    return counts, hits


def _union(spans: list) -> list:
    out: list = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def n_hit() -> Column:
    """Words in ``spans``."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)


def _joined(a: Hit, b: Hit) -> Hit:
    best = max(a, b, key=lambda x: (x.longest, -x.longest_at))
    return Hit(_union(a.spans + b.spans), sorted({*a.items, *b.items}), *best[2:])


def is_contaminated(n_words: int, spans: list) -> bool:
    n_hit = sum(spans[1::2]) - sum(spans[::2])
    return n_hit > 0 and 20 * n_hit >= n_words


NOTHING = Hit([], [], 0, None, None)


def _matches(column: pa.Array, block: Block) -> tuple[np.ndarray, dict[int, Hit]]:
    """Words of each row's text, and what was found in those with a hit."""
    n_words, hits = np.zeros(len(column), np.int64), {}
    for texts in arrays.slices(column.fill_null(""), SHARD_BYTES):
        counts, found = match_slice(texts, block)
        n_words[texts.first : texts.first + len(texts)] = counts
        hits |= {texts.first + t: hit for t, hit in found.items()}
    return n_words, hits


def _structs(n_words: np.ndarray, hits: list[Hit]) -> pa.Array:
    return pa.array([hit._asdict() | {"n_words": int(n)} for hit, n in zip(hits, n_words, strict=True)], FOUND_KIND)


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, block_words: int) -> list[DataFrame]:
    """A row with the packed block for each: items go into blocks in their order, by a running total of their size; blocks without a word are left out."""

    def build(key: tuple, items: pa.Table) -> pa.Table:
        items = items.sort_by("row")
        block = build_block(list(zip(items["item"].to_pylist(), items["text"].to_pylist(), strict=True)))
        some = [block] if block else []
        return pa.table({"block": pa.array([key[0].as_py()] * len(some), pa.int64()), "packed": pa.array([pickle.dumps(b) for b in some], pa.binary())})

    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("string").alias("item"), text.alias("text"), (F.floor(F.length(text) / 2) + 1).alias("size"))
    total = running_total(rows, [], ["row"], "total", "size")
    dealt = total.select(F.floor((F.col("total") - 1) / block_words).alias("block"), "row", "item", "text")
    built = keep(dealt.groupBy("block").applyInArrow(build, "block long, packed binary"))
    #: The numbers of the blocks come to the driver, and each block by itself when it is broadcast.
    return [built.where(F.col("block") == r["block"]).select("packed") for r in built.select("block").orderBy("block").collect()]


def _one_pass(docs: DataFrame, packed: DataFrame, text_at: int, only_clean: bool) -> DataFrame:
    """``docs`` plus what a block finds, or its clean rows."""
    held = docs.sparkSession.sparkContext.broadcast(bytes(packed.first()["packed"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pickle.loads(held.value)
        for batch in batches:
            n_words, hits = _matches(batch.column(text_at), block)
            if only_clean:
                yield batch.filter(pa.array([i not in hits or not is_contaminated(n, hits[i].spans) for i, n in enumerate(n_words.tolist())], pa.bool_()))
            else:
                found = _structs(n_words, [hits.get(i, NOTHING) for i in range(batch.num_rows)])
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, CARRIED])

    return docs.mapInArrow(run, docs.schema if only_clean else T.StructType([*docs.schema.fields, T.StructField(CARRIED, FOUND)]))


def _several_passes(numbered: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """``row`` and what all blocks find, for each of ``numbered`` (row, text); one block is held at a time."""
    found = []
    for packed in blocks:
        held = numbered.sparkSession.sparkContext.broadcast(bytes(packed.first()["packed"]))

        def run(batches: Iterator[pa.RecordBatch], held=held, first=not found) -> Iterator[pa.RecordBatch]:
            block = pickle.loads(held.value)
            for batch in batches:
                n_words, hits = _matches(batch.column(1), block)
                told = np.arange(batch.num_rows) if first else np.array(sorted(hits), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(told)), _structs(n_words[told], [hits.get(i, NOTHING) for i in told.tolist()])], names=["row", CARRIED])

        found.append(keep(numbered.mapInArrow(run, T.StructType([numbered.schema["row"], T.StructField(CARRIED, FOUND)]))))
        held.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, n_words = [], []
            for parts in batch.column(1).to_pylist():
                some = [Hit(*(p[name] for name in Hit._fields)) for p in parts if p["spans"]]
                hits.append(reduce(_joined, some) if some else NOTHING)
                n_words.append(parts[0]["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column(0), _structs(n_words, hits)], names=["row", CARRIED])

    # A row has as many parts as there are blocks at most.
    listed = every.groupBy("row").agg(F.collect_list(CARRIED).alias("parts"))
    return listed.mapInArrow(merge, found[0].schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    benchmark_id: str = "item_id", benchmark_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items, contaminated, spans, longest, longest_at, longest_item.

    Words are runs of ASCII letters, digits and anything not ASCII, A-Z lower-cased; null texts have
    none. A document word is hit if it lies in an occurrence of a window: ``WINDOW`` words in a row of
    an item, or a shorter item whole. ``spans`` has the hit words as start, end, start, end; ``longest``
    is the longest verbatim match in words, ``longest_at`` the document word where it starts. Items
    with equal ids are one, items without id hit but are not named; an item without words or an empty
    benchmark hits nothing. Repeated rows each get a row. Other columns are not read.
    """
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    blocks = _blocks(benchmark, benchmark_id, benchmark_text, block_words)
    if len(blocks) == 1:
        out = _one_pass(picked, blocks[0], 1, False)
    elif blocks:
        numbered = keep(picked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
        out = numbered.select("row", "doc_id").join(_several_passes(numbered.select("row", "text"), blocks), "row")
    else:
        empty = F.expr("CAST(array() AS array<bigint>)")
        words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
        out = picked.withColumn(CARRIED, F.struct(empty.alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items"), F.lit(0).cast("long").alias("longest"), F.lit(None).cast("long").alias("longest_at"), F.lit(None).cast("string").alias("longest_item"), words.alias("n_words")))
    found = out.select("doc_id", f"`{CARRIED}`.*")
    found = found.withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans", "longest", "longest_at", "longest_item",
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", benchmark_id: str = "item_id",
    benchmark_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; with one block nothing is shuffled."""
    blocks = _blocks(benchmark, benchmark_id, benchmark_text, block_words)
    if len(blocks) < 2:
        return _one_pass(docs, blocks[0], docs.columns.index(text_column), True) if blocks else docs
    number = free_name(docs, "row")
    numbered = keep(docs.withColumn(number, F.monotonically_increasing_id()))
    found = _several_passes(numbered.select(F.col(number).alias("row"), F.col(text_column).alias("text")), blocks).select(F.col("row").alias(number), f"{CARRIED}.*")
    contaminated = found.where((n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))).select(number)
    return numbered.join(contaminated, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
