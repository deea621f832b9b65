"""Operator 4, language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Classes are the end, the most frequent words one by
one, and all other words by how they end. The class is predicted by a softmax over hashed features of the
history: n-grams of words and of classes, and skips over the last word. Inside a class a word has (count + 1)
over the sum of that for all its words and one unknown word, the solution of a softmax with a constant for
each word. All adds up to 1 over known words and one unknown word a class.

The corpus is tokenised once, into blocks with their own list of distinct words. Counts of all words are summed
in buckets of words: a block sends each bucket one row with all its words there, and gets the sums back in that
order, so that no table of words is ever broadcast. What a score owes to the classes needs no sums of other blocks
and is found before the blocks are shuffled to meet them, so that their words need not be sent again.
Each training block takes part in one round of gradient updates: every task goes on from the weights of the last
round, and the changes are averaged feature by feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .store import keep

BLOCK_BYTES = 4 << 20
FREQUENT, ENDINGS = 15, 32
CLASSES = 1 + FREQUENT + ENDINGS
FEATURES = 1 << 14
TEMPLATES = 4
ROUNDS, RATE, BATCH = 2, 0.4, 8192
BUCKET_WORDS = 2 << 20  # in all blocks' lists together
PIECE = 512  # tokens or features whose rows of classes stay in the cache
SHORT = 8  # tokens of a batch with the same feature
END = int(arrays.seeds(1, 5000)[0])
START = np.uint64(0x5BD1E995)


class Model(NamedTuple):
    frequent: np.ndarray  # sorted hashes of the words with a class of their own
    constant: np.ndarray  # [class]
    weights: np.ndarray  # [feature, class]


class Counts(NamedTuple):
    tokens: int  # N, ends included
    words: int  # V, the end included
    class_tokens: np.ndarray
    class_words: np.ndarray


@lru_cache(maxsize=1)
def _endings() -> np.ndarray:
    """The kind of ending for each last byte * 256 + byte before."""
    return arrays.mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77)) % np.uint64(ENDINGS)


def _hashed(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Words of a slice as hashes, whose last bits say how the word ends, and how many each text has."""
    found = arrays.words(texts)
    last = arrays.LOWER[texts.data[found.end - 1]].astype(np.int64)
    before = np.where(found.end - found.start > 1, arrays.LOWER[texts.data[np.maximum(found.end - 2, 0)]], 0)
    hashes = arrays.word_hashes(texts, found)
    return hashes - hashes % np.uint64(ENDINGS) + _endings()[last * 256 + before], np.diff(found.first)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, frequent ones first, equally frequent ones by hash; and each token's place among them."""
    found = pa.array(hashes).dictionary_encode()
    words, codes = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(words)
    order = order[np.argsort(-np.bincount(codes, minlength=len(words))[order], kind="stable")]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return words[order], rank[codes]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (row, doc_id, held_out, text): ids, where each document's tokens start, distinct words, how often training
    rows have each, and the tokens as numbers of words. The words stand by frequency, so that the numbers pack well."""
    seen = 0
    for batch in batches:
        text = batch.column(3).fill_null("")
        for texts in arrays.slices(text, BLOCK_BYTES):
            part = batch.slice(texts.first, len(texts))
            hashed = [_hashed(some) for some in arrays.slices(text.slice(texts.first, len(texts)))]
            counts = np.concatenate([c for _, c in hashed])
            words, codes = _numbered(np.concatenate([h for h, _ in hashed]))
            first = np.concatenate([[0], np.cumsum(counts + 1)])
            tokens = np.zeros(first[-1], np.uint32)
            tokens[np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)] = codes + 1
            held = np.asarray(part.column(2).to_pylist(), bool)
            learned = np.bincount(tokens[~np.repeat(held, counts + 1)], minlength=len(words) + 1)
            block = (TaskContext.get().partitionId() << 32) + seen
            seen += 1
            as_list = lambda x: pa.array([x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]), pa.array([part.column(1).to_pylist()], pa.list_(part.column(1).type)), pa.array([held.tolist()], pa.list_(pa.bool_())),
                    as_list(first), as_list(np.concatenate([[np.uint64(END)], words]).view(np.int64)), as_list(learned),
                    pa.array([_packed(tokens)], pa.binary()), pa.array([len(words) + 1]),
                ],
                names=["block", "ids", "held_out", "first", "words", "learned", "tokens", "n_words"],
            )


def _blocks_schema(kind: T.DataType) -> T.StructType:
    lists = {"ids": kind, "held_out": T.BooleanType(), "first": T.LongType(), "words": T.LongType(), "learned": T.LongType()}
    return T.StructType([T.StructField("block", T.LongType()), *(T.StructField(n, T.ArrayType(k)) for n, k in lists.items()), T.StructField("tokens", T.BinaryType()), T.StructField("n_words", T.LongType())])


def _column(batch: pa.RecordBatch | pa.Table, name: str, row: int) -> np.ndarray:
    """A list of one row as an array."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column[row].values.to_numpy(zero_copy_only=False)


def _packed(tokens: np.ndarray) -> bytes:
    """Compressed with all lowest bytes first, as the higher ones differ little."""
    return pa.compress(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _tokens(batch: pa.RecordBatch | pa.Table, row: int, count: int) -> np.ndarray:
    parts = np.frombuffer(pa.decompress(batch.column("tokens")[row].as_buffer(), 4 * count, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(parts.reshape(4, -1).T).view(np.uint32).ravel()


def buckets_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word, by its first bits, so that words in the order of their hashes are in that of the buckets."""
    return (((words >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int32)


def _shares(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, learned = _column(batch, "words", row), _column(batch, "learned", row)
                bucket = buckets_of(words.view(np.uint64), buckets)
                order = np.argsort(bucket, kind="stable")
                there, begin = np.unique(bucket[order], return_index=True)
                bounds = pa.array(np.append(begin, len(words)), pa.int32())
                columns = [np.full(len(there), batch.column("block")[row].as_py()), there]
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in (words, learned)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], names=["block", "bucket", "words", "learned"])

    return run


def _summed(shares: pa.Table) -> pa.Table:
    """For each block of a bucket how often training rows of all blocks have its words; and a row on the bucket's known words."""
    column = lambda name: shares.column(name).combine_chunks()
    words, inverse = np.unique(column("words").flatten().to_numpy().view(np.uint64), return_inverse=True)
    n = np.bincount(inverse, column("learned").flatten().to_numpy(), len(words)).astype(np.int64)
    kind = np.where(words == np.uint64(END), 0, 1 + (words % np.uint64(ENDINGS)).astype(np.int64))
    top = np.flatnonzero((n > 0) & (kind > 0))
    top = top[np.lexsort((words[top].view(np.int64), -n[top]))[:FREQUENT]]
    each = {"n_by_ending": np.bincount(kind, n, 1 + ENDINGS), "words_by_ending": np.bincount(kind[n > 0], minlength=1 + ENDINGS), "top": words[top].view(np.int64), "n_of_top": n[top]}
    sizes = pc.list_value_length(column("words")).to_numpy()
    by_block = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(n[inverse]))
    kinds = pa.list_(pa.int64())
    rows = [column("block").cast(pa.int64()), column("bucket").cast(pa.int32()), by_block, *(pa.nulls(len(sizes), kinds) for _ in each)]
    about = [pa.nulls(1, pa.int64()), column("bucket")[:1].cast(pa.int32()), pa.nulls(1, kinds), *(pa.array([x.astype(np.int64)], kinds) for x in each.values())]
    return pa.table([pa.chunked_array([a, b]) for a, b in zip(rows, about, strict=True)], names=["of_block", "bucket", "n", *each])


def _count(blocks: DataFrame, buckets: int) -> DataFrame:
    """What ``_summed`` says of each block and bucket, and of each bucket with of_block null."""
    numbers = T.ArrayType(T.LongType())
    block, bucket = T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType())
    shares = blocks.select("block", "words", "learned").mapInArrow(_shares(buckets), T.StructType([block, bucket, T.StructField("words", numbers), T.StructField("learned", numbers)]))
    lists = ("n", "n_by_ending", "words_by_ending", "top", "n_of_top")
    return shares.groupBy("bucket").applyInArrow(_summed, T.StructType([T.StructField("of_block", T.LongType()), bucket, *(T.StructField(n, numbers) for n in lists)]))


def classes_of(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    out = 1 + FREQUENT + (words % np.uint64(ENDINGS)).astype(np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        out = np.where(frequent[place] == words, 1 + place, out)
    out[words == np.uint64(END)] = 0
    return out


@lru_cache(maxsize=1)
def _of_classes() -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the last two classes, and of the last three; CLASSES stands for the start of a document."""
    m = arrays.seeds(4, 6000)
    c = np.append(np.arange(CLASSES, dtype=np.uint64), START)
    two = c[:, None] * m[0] + c * m[1]
    return _feature(two + np.uint64(2)), _feature(two[:, :, None] + c * m[3] + np.uint64(4))


def _feature(hashed: np.ndarray) -> np.ndarray:
    return arrays.fold_mod(arrays.mixed(hashed), FEATURES).astype(np.int32)


def histories(words: np.ndarray, classes: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[token, template] feature numbers of each token's history; the history begins anew in each document. Tokens are places in the lists of words and their classes."""
    n = len(tokens)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))

    def back(step: int) -> np.ndarray:
        out = np.full(n, len(words), np.int64)
        if step < n:
            np.copyto(out[step:], tokens[: n - step], where=place[step:] >= step)
        return out

    b1, b2 = back(1), back(2)
    c = np.append(classes, CLASSES)
    c1, c2, c3 = c[b1], c[b2], c[back(3)]
    m = arrays.seeds(4, 6000)
    started = np.append(words, START)
    two, three = _of_classes()
    out = np.empty((n, TEMPLATES), np.int32)
    out[:, 0] = _feature(started * m[0] + np.uint64(1))[b1]
    out[:, 1] = two[c1, c2]
    out[:, 2] = _feature(started * m[2] + np.uint64(3))[b2]
    out[:, 3] = three[c1, c2, c3]
    return out


def features(words: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``histories`` of tokens that are given as words themselves, with their classes."""
    return histories(words, classes, np.arange(len(words)), first)


def _logits(model: Model, x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """[token, class] logits of a piece, the largest of a token 0."""
    room = np.empty_like(out)
    np.take(model.weights, x[:, 0], 0, out=out, mode="clip")
    for t in range(1, TEMPLATES):
        out += np.take(model.weights, x[:, t], 0, out=room, mode="clip")
    out += model.constant
    out -= np.ascontiguousarray(out.T).max(0)[:, None]
    return out


def log_classes(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's class y."""
    own, total = np.empty(len(y), np.float32), np.empty(len(y), np.float32)
    room = np.empty((min(PIECE, len(y)), CLASSES), np.float32)
    for at in range(0, len(y), PIECE):
        some = y[at : at + PIECE]
        logits = _logits(model, x[at : at + PIECE].astype(np.intp), room[: len(some)])
        own[at : at + PIECE] = logits[np.arange(len(some)), some]
        total[at : at + PIECE] = np.exp(logits, out=logits).sum(1)
    return own - np.log(total)


def _added(values: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sum of the rows ``order[begin[i]:begin[i + 1]]`` for each i: many short sums of one length at once, the others as numpy reduces them."""
    size = np.diff(begin, append=len(order))
    out = np.empty((len(begin), values.shape[1]), values.dtype)
    for k in range(1, SHORT + 1):
        which = np.flatnonzero(size == k)
        at = begin[which]
        total = np.take(values, order[at + min(1, k - 1)], 0, mode="clip")
        if k > 1:
            room = np.empty_like(total)
            for j in (*range(2, k), 0):
                total += np.take(values, order[at + j], 0, out=room, mode="clip")
        out[which] = total
    which = np.flatnonzero(size > SHORT)
    if len(which):
        rows = order[np.repeat(size > SHORT, size)]
        starts = np.cumsum(size[which]) - size[which]
        out[which] = np.add.reduceat(np.take(np.ascontiguousarray(values.T), rows, 1, mode="clip"), starts, 1).T
    return out


def update(model: Model, squares: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """A step of adaptive gradient descent on a batch, in place."""
    x = x.astype(np.intp)
    slope = np.empty((len(y), CLASSES), np.float32)
    for at in range(0, len(y), PIECE):
        part = _logits(model, x[at : at + PIECE], slope[at : at + PIECE])
        np.exp(part, out=part)
        part /= part.sum(1, keepdims=True)
    slope[np.arange(len(y)), y] -= 1
    flat = x.T.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
    rows = flat[order[begin]]
    total = _added(slope, order % len(y), begin)
    for at in range(0, len(rows), PIECE):
        some, step = rows[at : at + PIECE], total[at : at + PIECE]
        grown = step * step
        grown += squares[some]
        squares[some] = grown
        grown += 1
        step *= RATE
        step /= np.sqrt(grown, out=grown)
        model.weights[some] -= step


def _trainer(held_model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = held_model.value
        model, squares, seen = None, None, np.zeros(FEATURES)
        for batch in batches:
            for row in range(batch.num_rows):
                words = _column(batch, "words", row).view(np.uint64)
                first = _column(batch, "first", row)
                tokens = _tokens(batch, row, first[-1])
                held = _column(batch, "held_out", row).astype(bool)
                if model is None:
                    model, squares = Model(start.frequent, start.constant, start.weights.copy()), np.zeros_like(start.weights)
                of_word = classes_of(words, start.frequent)
                classes = of_word[tokens]
                use = np.flatnonzero(np.repeat(~held, np.diff(first)))
                x = histories(words, of_word, tokens, first)
                for at in range(0, len(use), BATCH):
                    some = use[at : at + BATCH]
                    update(model, squares, x[some], classes[some])
                seen += np.bincount(x[use].ravel(), minlength=FEATURES)
        if model is not None:
            rows = np.flatnonzero(seen)
            change = (model.weights[rows] - start.weights[rows]) * seen[rows, None]
            columns = [pa.array(np.ascontiguousarray(change[:, c], np.float32)) for c in range(CLASSES)]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(seen[rows]), *columns], names=["feature", "seen", *(f"c{c}" for c in range(CLASSES))])

    return run


def _round(blocks: DataFrame, model: Model) -> Model:
    """The model after one round; FEATURES rows of CLASSES numbers come back at most."""
    held = blocks.sparkSession.sparkContext.broadcast(model)
    names = [f"c{c}" for c in range(CLASSES)]
    schema = T.StructType([T.StructField("feature", T.LongType()), T.StructField("seen", T.DoubleType()), *(T.StructField(n, T.FloatType()) for n in names)])
    changes = blocks.select("held_out", "first", "words", "tokens").mapInArrow(_trainer(held), schema)
    mean = changes.groupBy("feature").agg(*((F.sum(n) / F.sum("seen")).alias(n) for n in names)).orderBy("feature").toArrow()
    weights = model.weights.copy()
    if mean.num_rows:
        weights[mean.column(0).to_numpy()] += np.stack([mean.column(n).to_numpy() for n in names], 1).astype(np.float32)
    held.destroy()
    return model._replace(weights=weights)


def _by_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(first) - 1), np.diff(first)), values, len(first) - 1)


def _class_scorer(held_model, counts: Counts, buckets: int):
    """Blocks without their words, but with each word's bucket, and by document all of the score but the words' own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = held_model.value
            inside = np.log10(counts.class_tokens + counts.class_words + 1)
            for row in range(batch.num_rows):
                words = _column(batch, "words", row).view(np.uint64)
                first = _column(batch, "first", row)
                tokens = _tokens(batch, row, first[-1])
                of_word = classes_of(words, model.frequent)
                classes = of_word[tokens]
                x = histories(words, of_word, tokens, first)
                part = _by_document(log_classes(model, x, classes) / np.log(10) - inside[classes], first)
                given = batch.slice(row, 1).select(["block", "ids", "held_out", "first", "tokens"])
                lists = [pa.array([buckets_of(words, buckets)], pa.list_(pa.int32())), pa.array([part], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*given.columns, *lists], names=[*given.schema.names, "buckets", "part"])

    return run


def _scorer(counts: Counts):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        kind = left.schema.field("ids").type.value_type
        n = right.sort_by("bucket").column("n").combine_chunks().flatten().to_numpy()
        for row in range(left.num_rows):
            first = _column(left, "first", row)
            tokens = _tokens(left, row, first[-1])
            known = np.empty(len(n))
            known[np.argsort(_column(left, "buckets", row), kind="stable")] = n
            own = _by_document(np.log10(known + 1)[tokens], first)
            out["doc_id"] += left.column("ids")[row].as_py()
            out["held_out"] += left.column("held_out")[row].as_py()
            out["n_tokens"] += np.diff(first).tolist()
            out["n_known"] += _by_document((known > 0)[tokens], first).astype(np.int64).tolist()
            out["base_score"] += (own - np.diff(first) * np.log10(counts.tokens + counts.words + 1)).tolist()
            out["score"] += (own + _column(left, "part", row)).tolist()
        return pa.table([pa.array(out["doc_id"], kind), pa.array(out["held_out"], pa.bool_()), *(pa.array(out[n], pa.int64()) for n in ("n_tokens", "n_known")), *(pa.array(out[n], pa.float64()) for n in ("base_score", "score"))], names=list(out))

    return run


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows for which ``held_out`` is not true. Tokens are words between white space, A-Z
    lower-cased, then one end. ``base_score`` is the log10 probability under counts plus one, ``score`` that of
    the model. A null or empty text is one end. Words are told apart by 64-bit hashes. Repeated rows count and
    are scored each for itself; without any training row all words are unknown. An empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType
    blocks = keep(rows.mapInArrow(_encode, _blocks_schema(kind)))
    spark = docs.sparkSession
    listed = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed // BUCKET_WORDS))
    counted = keep(_count(blocks, buckets))
    about = counted.where("of_block is null")
    top = about.select(F.explode(F.arrays_zip(F.col("top").alias("word"), F.col("n_of_top").alias("n"))).alias("x")).select("x.word", "x.n").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    pairs = F.arrays_zip(F.col("n_by_ending").alias("n"), F.col("words_by_ending").alias("v"))
    by_ending = about.select(F.posexplode(pairs).alias("kind", "x")).groupBy("kind").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v")).collect()
    frequent = np.sort(np.array([r["word"] & (2**64 - 1) for r in top], np.uint64))
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_ending:
        at = FREQUENT + r["kind"] if r["kind"] else 0
        class_tokens[at], class_words[at] = r["n"], r["v"]
    tokens, words = int(class_tokens.sum()), int(class_words.sum())
    for r in top:
        word = np.array([r["word"] & (2**64 - 1)], np.uint64)
        own, other = classes_of(word, frequent)[0], classes_of(word, frequent[:0])[0]
        class_tokens[[own, other]] += r["n"], -r["n"]
        class_words[[own, other]] += 1, -1
    counts = Counts(tokens, words, class_tokens, class_words)
    constant = np.log((class_tokens + 1) / (class_tokens.sum() + CLASSES)).astype(np.float32)
    model = Model(frequent, constant, np.zeros((FEATURES, CLASSES), np.float32))
    for r in range(rounds):
        model = _round(blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r), model)

    held = spark.sparkContext.broadcast(model)
    left = T.StructType(
        [*(T.StructField(n, blocks.schema[n].dataType) for n in ("block", "ids", "held_out", "first", "tokens")), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("part", T.ArrayType(T.DoubleType()))]
    )
    by_classes = blocks.select("block", "ids", "held_out", "first", "words", "tokens").mapInArrow(_class_scorer(held, counts, buckets), left)
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))]
    )
    sums = counted.where("of_block is not null").select("of_block", "bucket", "n")
    scored = by_classes.groupBy("block").cogroup(sums.groupBy("of_block")).applyInArrow(_scorer(counts), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
