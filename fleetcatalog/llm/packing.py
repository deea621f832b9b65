"""Operator 3, best-fit packing: token sequences into bins of several permitted lengths.

The documents are dealt over shards of about ``SHARD_ROWS`` by a hash; only ids and lengths are
shuffled. In a shard the longest piece goes first, into the open bin it leaves least room in. If it
fits none, a bin is opened of the size that costs least: the size's cost less the worth of the room
that pieces still to come could fill. At the end each bin takes the smallest size that holds it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .store import keep

SIZES = (512, 1024, 2048, 4096)
#: What a bin costs beside its tokens.
OVERHEAD = 16
SHARD_ROWS = 5_000


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row, doc_id, n_tokens for each row: words between white space, and one end token; 1 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for texts in arrays.slices(batch.column(2).fill_null("")):
                counts[texts.first : texts.first + len(texts)] = np.diff(arrays.words(texts).first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts + 1)], names=["row", "doc_id", "n_tokens"])

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, T.StructType([picked.schema["row"], picked.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """For lengths that fall, none above the largest size: each one's bin and offset; and each bin's final size."""
    sizes = sorted(sizes)
    rate = min((size + overhead) / size for size in sizes)
    rising = np.asarray(lengths, np.int64)[::-1]
    below = np.concatenate([[0], np.cumsum(rising)])
    room: list[tuple[int, int]] = []  # (room left, bin) of open bins
    open_room, filled, bins, offsets = 0, [], [], []
    capacity: list[int] = []
    for k, length in enumerate(lengths):
        at = bisect_left(room, (length, -1))
        if at < len(room):
            left, chosen = room.pop(at)
            open_room -= left
        else:
            to_come = len(rising) - k - 1

            def cost(size: int) -> float:
                spare = size - length
                fits = int(below[min(to_come, int(np.searchsorted(rising, spare, "right")))])
                return size + overhead - rate * min(spare, max(0, fits - open_room))

            left = min((size for size in sizes if size >= length), key=lambda size: (cost(size), size))
            chosen = len(filled)
            filled.append(0)
            capacity.append(left)
        bins.append(chosen)
        offsets.append(filled[chosen])
        filled[chosen] += length
        if left > length:
            insort(room, (left - length, chosen))
            open_room += left - length
    return bins, offsets, [sizes[bisect_left(sizes, n)] for n in filled]


def pack(lengths: DataFrame, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, bin_id, bin_size, bin_offset.

    ``lengths`` has row, doc_id and n_tokens. A document longer than the largest size is cut into pieces
    of that size and a rest; ``start`` is a piece's first token in its document. Lengths of null or less
    than 1 give no piece. Ids keep their type and value, null or not. Repeated rows are packed each for itself.
    An empty table gives no rows.
    """
    largest = max(sizes)
    lengths = keep(lengths.select("row", "doc_id", "n_tokens"))
    shards = max(1, -(-lengths.count() // shard_rows))
    names = ("piece", "start", "length", "bin_id", "bin_size", "bin_offset")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.greater(rows["n_tokens"], 0)).sort_by("row")
        tokens = rows["n_tokens"].to_numpy().astype(np.int64)
        pieces = -(-tokens // largest)
        owner = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(tokens[owner] - piece * largest, largest)
        order = np.lexsort((piece, owner, -length))
        bins, offsets, final = (np.asarray(x, np.int64) for x in best_fit(length[order].tolist(), sizes, overhead))
        bin_id, bin_size = (key[0].as_py() << 32) + bins, final[bins] if len(bins) else bins
        columns = piece[order], piece[order] * largest, length[order], bin_id, bin_size, offsets
        return pa.table([rows["doc_id"].take(pa.array(owner[order])), *map(pa.array, columns)], ["doc_id", *names])

    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    schema = T.StructType([lengths.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names]])
    return lengths.select("*", shard).groupBy("shard").applyInArrow(run, schema)
