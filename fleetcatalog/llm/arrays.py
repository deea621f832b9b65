"""Texts of an Arrow batch as numpy arrays: bytes, words, hashes of words and of runs of words.

Work goes slice by slice of whole texts, so that the arrays stay small whatever a batch holds; a
single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
ASCII_SPACE = (0x20, *range(0x09, 0x0E))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, value by value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(count: int, start: int = 0) -> np.ndarray:
    """Odd numbers that look random, the same in every process."""
    return mixed((np.arange(start + 1, start + count + 1, dtype=np.uint64)) * np.uint64(BASE)) | np.uint64(1)


def table(members) -> np.ndarray:
    """256 booleans: which bytes are members."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words between white space.
SPACED = ~table(ASCII_SPACE)
#: Bytes of words of letters, digits and all that is not ASCII.
ALNUM = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Texts(NamedTuple):
    """Texts one after the other: text i is ``data[offsets[i]:offsets[i + 1]]``; the first is row ``first`` of its batch."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Words in order: where each starts and ends in the data, and the text it is in; text i has words ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The UTF-8 bytes of a column without nulls, cut between rows into slices of up to ``limit`` bytes or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield Texts(at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]])
        at = to


def words(texts: Texts, member: np.ndarray = SPACED) -> Words:
    """Maximal runs of member bytes inside each text."""
    inside = member[texts.data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    bounds = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(inside))]
    before[bounds] = False
    after[bounds - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, texts.offsets)
    return Words(start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return seeds(256)


_POWERS: dict[str, np.ndarray] = {}


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for the usual slices, made anew for a longer text."""
    if len(_POWERS.get("up", ())) < count:
        size = max(count, SLICE_BYTES + 1)
        up, down = np.full(size, BASE, np.uint64), np.full(size, BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > 4 * SLICE_BYTES + 1:
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: Texts, found: Words, fold: bool = True) -> np.ndarray:
    """64 bits for each word, equal for equal bytes; ``fold``: A-Z as a-z."""
    if not len(found.start):
        return np.zeros(0, np.uint64)
    letters = _letters()[LOWER] if fold else _letters()
    up, down = _powers(len(texts.data) + 1)
    total = np.zeros(len(texts.data) + 1, np.uint64)
    np.cumsum(letters[texts.data] * up[: len(texts.data)], out=total[1:])
    return mixed((total[found.end] - total[found.start]) * down[found.start])


def run_hashes(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each ``length`` words in a row inside one text, and where the runs of text i start in them.

    A text with fewer words, but not none, has one run: all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(runs)])
    if not len(hashes):
        return np.zeros(0, np.uint64), starts
    padded = np.concatenate([hashes, np.zeros(length, np.uint64)])
    factors = seeds(length, 1000)
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], runs) + np.repeat(first[:-1], runs)
    left = np.repeat(counts, runs)
    out = np.zeros(len(at), np.uint64)
    for j in range(length):
        part = padded[at + j] * factors[j]
        out += part if j == 0 else np.where(left > j, part, np.uint64(0))
    return mixed(out), starts


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i; 0 where there are none."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def fold_mod(values: np.ndarray, size: int) -> np.ndarray:
    return (values % np.uint64(size)).astype(np.int64)
