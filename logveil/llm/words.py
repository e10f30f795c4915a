"""Words of whole text columns as numpy arrays, without a Python object per word.

A column is cut into slices of whole texts of about `SLICE` bytes (a longer text is a slice of its
own), so that memory follows one slice. In a slice, words are byte ranges of one buffer, and each
has a 64-bit hash: a polynomial over its bytes, read off prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession

SLICE = 1 << 19
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters, digits and everything beyond ASCII.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def released(run: Callable) -> Callable:
    """A task function that gives its memory back at the end; idle Python workers keep it otherwise."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return task


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast value, opened in a task by calling this; classes travel with it as code."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


@dataclass
class Words:
    """Words of texts `first` to `first + len(cut) - 2` of a column; text i has words cut[i] to cut[i + 1]."""

    first: int
    bytes: np.ndarray
    text_at: np.ndarray  # where each text begins in `bytes`, and the end
    start: np.ndarray
    end: np.ndarray
    cut: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.cut) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.cut)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, SLICE + 1)
        made = []
        for base in (_STEP, _BACK):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        if size > 4 * SLICE:
            return made[0], made[1]  # too large to keep
        _tables[:] = made
    return _tables[0], _tables[1]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its offsets into them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, breaks: np.ndarray = BLANKS, lower: bool = False) -> Iterator[Words]:
    """Slices of the column, in order, that cover every text once."""
    if not len(column):
        return
    data, at = buffers(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        part, cut = data[at[first] : at[last]], at[first : last + 1] - at[first]
        if lower:
            part = _LOWER[part]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~breaks[part]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edge = cut[:-1][cut[:-1] < cut[1:]]  # first bytes of texts that have any
        begins[edge] = inside[1:-1][edge]
        edge = cut[1:][cut[:-1] < cut[1:]] - 1
        ends[edge] = inside[1:-1][edge]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Words(first, part, cut, start, end, np.searchsorted(start, cut), _hashes(part, start, end))
        first = last


def windows(w: Words, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, 64-bit hash) of every window of `size` words inside one text."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factor = np.uint64((2 * seed + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole = whole * factor + (w.hash[k : k + n] ^ np.uint64(seed))
    place = np.flatnonzero(np.repeat(w.cut[1:], w.counts)[:n] >= np.arange(n) + size)
    return place, mix(whole[place])


def covered(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask of the places that lie in a window of `size` beginning at one of `starts`."""
    change = np.zeros(total + size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change)[:total] > 0


def per_text(w: Words, mask: np.ndarray) -> np.ndarray:
    """How many words of each text are set in `mask`."""
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[w.cut[1:]] - sums[w.cut[:-1]]
