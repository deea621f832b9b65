"""Operator 11, importance resampling towards a target: hashed runs of words weigh a document, Gumbel noise draws it.

A run's bucket is the CRC-32 of its bytes. CRC-32 is linear over GF(2) but for a constant per
length, so the value of a run is the XOR of what each byte gives at its distance from the run's end:
one lookup by (distance, byte), and one ``bitwise_xor.reduceat`` for all runs of a slice of texts.
Runs longer than ``BLOCK`` bytes are cut from their end into blocks; a block's value is carried
over the bytes after it by the powers of two of whole blocks, and the blocks of a run are XORed.

The corpus is read twice: for the counts of the buckets, added up task by task, and for the weights
of the documents under the gain of each bucket, a table of fixed size that is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import running_total
from . import arrays
from .store import free_name, keep

BUCKETS = 10_000
#: Words in a run.
LONGEST = 2
LEAST_WORDS = 20
#: Documents drawn of a hundred that have enough words.
PERCENT = 25
SEED = 7
#: Bytes whose contributions are in the position table, and how many blocks are looked up at once.
BLOCK, AT_ONCE = 64, 1 << 15
POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=1)
def _positions() -> np.ndarray:
    """[distance, byte]: what a byte adds to the checksum when so many bytes of its run come after it."""
    out = np.zeros((BLOCK, 256), np.uint32)
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1)
    out[0] = value
    for d in range(1, BLOCK):
        out[d] = (out[d - 1] >> 8) ^ out[0][out[d - 1] & 0xFF]
    return out


@lru_cache(maxsize=64)
def _carry(power: int) -> np.ndarray:
    """[4, 256]: a checksum's bytes, low first, carried over ``2**power`` blocks of zero bytes."""
    if power:
        half = _carry(power - 1)
        return _carried(_carried(np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None]), half), half)
    value = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(BLOCK):
        value = (value >> 8) ^ _positions()[0][value & 0xFF]
    return value


def _carried(value: np.ndarray, over: np.ndarray) -> np.ndarray:
    return over[0][value & 0xFF] ^ over[1][(value >> 8) & 0xFF] ^ over[2][(value >> 16) & 0xFF] ^ over[3][value >> 24]


def _over_blocks(value: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each checksum carried over so many whole blocks of zero bytes."""
    for power in range(int(blocks.max(initial=0)).bit_length()):
        some = np.flatnonzero((blocks >> power) & 1)
        value[some] = _carried(value[some], _carry(power))
    return value


@lru_cache(maxsize=1)
def _rests() -> np.ndarray:
    """The register that starts a checksum, after 0 to ``BLOCK`` - 1 zero bytes."""
    out = np.full(BLOCK, 0xFFFFFFFF, np.uint32)
    for d in range(1, BLOCK):
        out[d] = (out[d - 1] >> 8) ^ _positions()[0][out[d - 1] & 0xFF]
    return out


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start[i]:end[i]]`` for each i, as unsigned integers; spans may overlap, and an empty one has 0."""
    size = end - start
    blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), blocks)
    after = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(owner))
    high = end[owner] - after * BLOCK
    low = np.maximum(start[owner], high - BLOCK)
    table, value = _positions().ravel(), np.zeros(len(owner), np.uint32)
    for at in range(0, len(owner), AT_ONCE):
        a, b = low[at : at + AT_ONCE], high[at : at + AT_ONCE]
        first = np.cumsum(b - a) - (b - a)
        spread = np.repeat(np.stack([a - first, b - 1]), b - a, axis=1)
        place = np.arange(spread.shape[1]) + spread[0]
        value[at : at + AT_ONCE] = np.bitwise_xor.reduceat(table[((spread[1] - place) << 8) | data[place]], first)
    value = _over_blocks(value, after)
    out = _over_blocks(_rests()[size % BLOCK], size // BLOCK) ^ np.uint32(0xFFFFFFFF)
    some = np.flatnonzero(blocks)
    if len(some):
        out[some] ^= np.bitwise_xor.reduceat(value, (np.cumsum(blocks) - blocks)[some])
    return out


def run_buckets(texts: arrays.Texts, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words, the text each is in, and the words of each text.

    The words are put one after the other with a space in between, so that each run is a span of bytes.
    """
    found = arrays.words(texts, arrays.ALNUM)
    size = found.end - found.start
    joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = arrays.LOWER[texts.data[arrays.ALNUM[texts.data]]]
    end = np.cumsum(size + 1) - 1
    start = end - size
    out, text = [], []
    for more in range(min(longest, len(size))):
        one = np.flatnonzero(found.text[: len(size) - more] == found.text[more:])
        out.append(fold(crc32_spans(joined, start[one], end[one + more]), buckets))
        text.append(found.text[one])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out or none), np.concatenate(text or none), np.diff(found.first)


def fold(value: np.ndarray, buckets: int) -> np.ndarray:
    return (value % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many runs of all texts are in each bucket; each task adds up its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in arrays.slices(batch.column(0).fill_null("")):
                total += np.bincount(run_buckets(part, buckets, longest)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    got = texts.select(text_column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to that in the corpus, with one added to each count; floored."""
    buckets, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [float((t + 1) * (all_corpus + buckets)) / float((s + 1) * (all_target + buckets)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, the same for the same id: from the first 32 bits of the digest of ``seed:id``; a null id is as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def weigh(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text", longest: int = LONGEST, row_column: str | None = None) -> DataFrame:
    """row, doc_id, n_words, n_features, weight for each row: weight is the floored mean gain of the document's runs, 0 without any.

    ``row`` is null if no ``row_column`` is named.
    """
    buckets, held = len(gain), docs.sparkSession.sparkContext.broadcast(gain)
    row = F.lit(None).cast("long") if row_column is None else F.col(row_column)
    picked = docs.select(row.alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_runs, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for part in arrays.slices(batch.column(2).fill_null("")):
                at = slice(part.first, part.first + len(part))
                bucket, text, n_words[at] = run_buckets(part, buckets, longest)
                n_runs[at] = np.bincount(text, minlength=len(part))
                np.add.at(total[at], text, held.value[bucket])
            mean = total // np.maximum(n_runs, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words), pa.array(n_runs), pa.array(mean)], names=["row", "doc_id", "n_words", "n_features", "weight"]
            )

    numbers = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
    return picked.mapInArrow(run, T.StructType([picked.schema["row"], picked.schema["doc_id"], *numbers]))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighed`` plus score and rank: 1, 2, 3 ... for the drawn ones, null for the others.

    Of the documents with ``least_words`` or more, ``percent`` of a hundred are drawn (floored), those of the
    highest score; ties go to the smaller id, then to fewer runs, then to the smaller weight, and null ids
    come first. Ranks are counted slice by slice of the order, so no task has to hold all of it.
    """
    scored = keep(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    drawn = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    able, falling = (F.col("n_words") >= least_words), -F.col("score")
    ranked = running_total(scored.withColumns({"short": ~able, "falling": falling}), [], ["short", "falling", "doc_id", "n_features", "weight", "row"], "rank")
    return ranked.withColumn("rank", F.when(able & (F.col("rank") <= drawn), F.col("rank"))).drop("short", "falling")


def importance(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST, row_column: str | None = None,
) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score, rank for each row of ``docs``, drawn to be like the texts of ``target``.

    Words are runs of ASCII letters, digits and anything not ASCII, A-Z lower-cased. Null and empty texts have no
    words, weight 0, and are never drawn unless ``least_words`` is 0. Repeated rows count, and are ranked, each
    for itself. A text has to fit the memory of a task. Empty tables are allowed: without documents there are no
    rows, and without target texts the gains are those of an even target. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_column, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    return draw(weigh(docs, gain, id_column, text_column, longest, row_column), percent, least_words, seed)


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows are numbered once, in a table that both sides read."""
    number = free_name(docs, "row")
    numbered = keep(docs.withColumn(number, F.monotonically_increasing_id()))
    drawn = importance(numbered, target, id_column, text_column, row_column=number, **settings).where(F.col("rank").isNotNull())
    return numbered.join(drawn.select(F.col("row").alias(number)), number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
