"""Operator 12, vector code compression: product codes whose nearest entries are found by Orchard's search.

A vector's components become integers and are cut into ``PARTS`` parts; each part position has a
codebook of ``ENTRIES`` entries. Orchard's search keeps, for every entry, a list of the others by
rising distance from it. A part starts at an entry and walks that entry's list; when a candidate is
nearer, it jumps to the candidate's list. Entries seen before are marked and not measured again, and
the walk ends where the list's distance is above twice the current one, as all entries beyond are
farther by the triangle inequality. All parts of a batch walk together. Ties go to the lower entry.

A round reads the vectors once; each task adds up its parts by entry, and a table of the codebooks'
size is shuffled and comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Integers of this magnitude or more have no code: four times a squared distance has to fit 64 bits.
LARGEST = 1 << 26
ROWS_AT_ONCE = 2048


class Book(NamedTuple):
    """Entries of one part position, and for each the other entries by rising distance."""

    entries: np.ndarray  # [entry, position]
    others: np.ndarray  # [entry, step]
    squared: np.ndarray  # [entry, step]


def listed(entries: np.ndarray) -> Book:
    squared = ((entries[:, None] - entries[None]) ** 2).sum(2)
    apart = squared.copy()
    np.fill_diagonal(apart, -1)
    others = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return Book(entries, others, np.take_along_axis(squared, others, 1))


def nearest(parts: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """For each part the nearest entry, of equally near ones the lowest, and its squared distance."""
    steps = book.others.shape[1]
    now, step = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    best = ((parts - book.entries[0]) ** 2).sum(1)
    marked = np.zeros((len(parts), steps + 1), bool)
    marked[:, 0] = True
    walking = np.arange(len(parts))
    while steps:
        walking = walking[step[walking] < steps]
        entry, at = now[walking], step[walking]
        # An entry at just twice the distance may be as near as the current one, and lower.
        near = book.squared[entry, at] <= 4 * best[walking]
        walking, entry, at = walking[near], entry[near], at[near]
        if not len(walking):
            break
        candidate = book.others[entry, at]
        step[walking] += 1
        new = ~marked[walking, candidate]
        part, candidate = walking[new], candidate[new]
        marked[part, candidate] = True
        squared = ((parts[part] - book.entries[candidate]) ** 2).sum(1)
        better = (squared < best[part]) | ((squared == best[part]) & (candidate < now[part]))
        part = part[better]
        now[part], best[part], step[part] = candidate[better], squared[better], 0
    return now, best


def integers(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, -1 where they are null or have a component that is null or not finite; and all finite components as floored floats."""
    offsets = np.asarray(vectors.offsets)
    flat = pc.fill_null(vectors.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    broken = (bad[offsets[1:]] > bad[offsets[:-1]]) | np.asarray(vectors.is_null())
    return np.where(broken, -1, np.diff(offsets)), np.floor(np.where(np.isfinite(flat), flat, 0) * scale)


def batch_parts(vectors: pa.Array, length: int, parts: int = PARTS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[row, part, position] integers of the vectors that can have a code, which rows these are, and which rows are to be kept at all."""
    size, floored = integers(vectors, scale)
    usual = np.flatnonzero(size == length)
    offsets = np.asarray(vectors.offsets)
    value = floored[offsets[usual][:, None] + np.arange(length)] if len(floored) else np.zeros((len(usual), length))
    small = (np.abs(value) < LARGEST).all(1)
    out = np.zeros((int(small.sum()), parts * -(-length // parts)), np.int64)
    out[:, :length] = value[small]
    return out.reshape(len(out), parts, out.shape[1] // parts), usual[small], size >= 0


def _floored(x, scale: int):
    return F.floor(x.cast("double") * scale)


def first_books(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, scale: int = SCALE) -> tuple[int, np.ndarray]:
    """The length of the vector of the least id, and [part, entry, position] of the least ids' vectors of that length; 0 and none without vectors."""
    fine = vectors.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    order = F.col("vec_id").asc_nulls_last(), F.col("vector")
    least = fine.orderBy(*order).select(F.size("vector").alias("length")).first()
    length = least.length if least else 0
    if not length:
        return 0, np.zeros((parts, 0, 0), np.int64)
    able = fine.where((F.size("vector") == length) & F.forall("vector", lambda x: F.abs(_floored(x, scale)) < LARGEST))
    got = able.orderBy(*order).limit(entries).toArrow()["vector"].combine_chunks()
    return length, batch_parts(got, length, parts, scale)[0].transpose(1, 0, 2).copy()


def _assigned(part: np.ndarray, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    """[row, part] entries and squared distances, some rows at a time."""
    entry, squared = np.zeros(part.shape[:2], np.int64), np.zeros(part.shape[:2], np.int64)
    for at in range(0, len(part), ROWS_AT_ONCE):
        for k, book in enumerate(books):
            some = slice(at, at + ROWS_AT_ONCE)
            entry[some, k], squared[some, k] = nearest(part[some, k], book)
    return entry, squared


def improved(vectors: DataFrame, length: int, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The codebooks after a round: each entry becomes the floored mean of the parts nearest to it; one without parts stays."""
    parts, entries, width = books.shape
    held = vectors.sparkSession.sparkContext.broadcast([listed(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            part, _, _ = batch_parts(batch.column(0), length, parts, scale)
            cell = _assigned(part, held.value)[0] + np.arange(parts) * entries
            np.add.at(total, cell.ravel(), part.reshape(-1, width))
            count += np.bincount(cell.ravel(), minlength=len(count))
        some = np.flatnonzero(count)
        cells = np.repeat(some, width), np.tile(np.arange(width), len(some)), total[some].ravel(), np.repeat(count[some], width)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["cell", "position", "total", "n"])

    # The codebooks' size at most, whatever the number of vectors.
    sums = vectors.select("vector").mapInArrow(run, "cell long, position long, total long, n long").groupBy("cell", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = books.reshape(parts * entries, width).copy()
    out[sums["cell"].to_numpy(), sums["position"].to_numpy()] = sums["total"].to_numpy() // sums["n"].to_numpy()
    return out.reshape(books.shape)


def train(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[int, np.ndarray]:
    """Length of the vectors and the codebooks, [part, entry, position], after all rounds; ``vectors`` has vec_id and vector."""
    length, books = first_books(vectors, entries, parts, scale)
    for _ in range(rounds if books.size else 0):
        books = improved(vectors, length, books, scale)
    return length, books


def decoded(codes: np.ndarray, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """[row, component] of [row, part] codes: the middle of each entry's cells, in the scale of the vectors."""
    return (books[np.arange(len(books)), codes].reshape(len(codes), -1) + 0.5) / scale


def encode(vectors: DataFrame, length: int, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """code (two hex digits for each part) and error (squared distance) instead of vector; rows that are not kept go, other columns stay."""
    parts = len(books)
    held = vectors.sparkSession.sparkContext.broadcast([listed(b) for b in books] if books.size else [])
    digits = np.array([f"{e:02x}" for e in range(max(1, books.shape[1]))])
    at = vectors.columns.index("vector")
    others = [i for i in range(len(vectors.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rows, kept = batch_parts(batch.column(at), length, parts, scale)
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            if held.value and len(rows):
                entry, squared = _assigned(part, held.value)
                code[rows] = ["".join(x) for x in digits[entry].tolist()]
                error[rows] = squared.sum(1)
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in others), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*(batch.schema.names[i] for i in others), "code", "error"]
            )
            yield out.filter(pa.array(kept))

    fields = [vectors.schema[i] for i in others]
    return vectors.mapInArrow(run, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, label_error for each kept row, and the codebooks as [part, entry, position].

    Rows whose vector is null, or has a component that is null, NaN or infinite, are left out. Codebooks start from
    the least ids (null ids last, equal ids by their vectors); with fewer vectors than entries there are fewer
    entries. The first of them says how long vectors are: if that can't be cut evenly, zeros are added at the end.
    Kept vectors of another length, or with a component of 2**26 / ``scale`` or more, have a null code and a null
    error and do not count. Repeated rows count each for itself. ``label_error`` is the sum of the errors of equal
    labels; nulls are one label. An empty table gives no rows and empty codebooks. Other columns are not read.
    """
    picked = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    length, books = train(picked, entries, parts, rounds, scale)
    coded = keep(encode(picked, length, books, scale))
    # One row for each label; rows of a label are added up before they are shuffled, and never meet in one task.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "label", "code", "error", "label_error"), books
