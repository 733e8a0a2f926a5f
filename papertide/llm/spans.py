"""Array helpers for spans of text: hashing, a bounded hash table, ragged gathers and batch plumbing.

A span is a run of characters (or bytes) of one document. Its 64-bit key is a polynomial in an odd base, read off prefix sums, so
that the keys of all spans of a chunk cost a few vector operations; spans over LONG characters take their key from BLAKE2b instead.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASE = 0x9E3779B97F4A7C15
LONG = 96
#: Documents are taken together until they have this many characters, which bounds the arrays of a task.
CHUNK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            full = np.full(max(n, CHUNK + 4096), base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit keys of codes[start:end]; equal spans have equal keys in every chunk. Never 0."""
    power, inverse = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    term = codes.astype(np.uint64)
    term += np.uint64(1)
    term *= power[: len(codes)]
    np.cumsum(term, out=sums[1:])
    size = (ends - starts).astype(np.uint64)
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + size * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(codes[starts[k] : ends[k]].astype("<u4").tobytes(), digest_size=8).digest()
        h[k] = int.from_bytes(digest, "little")
    h[h == 0] = 1
    return h


class KeyTable:
    """Open addressing from non-zero 64-bit keys to row numbers 0, 1, ... in order of insertion."""

    def __init__(self, found: np.ndarray | None = None) -> None:
        self.slots, self.rows, self.n = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int32), 0
        if found is not None and len(found):
            self.add(found)

    def _first(self, k: np.ndarray) -> np.ndarray:
        return (k & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(k), -1, np.int32)
        at, left = self._first(k), np.arange(len(k))
        while len(left):
            held = self.slots[at]
            hit = held == k[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (held != 0)
            left, at = left[go], (at[go] + 1) & (len(self.slots) - 1)
        return out

    def add(self, k: np.ndarray) -> None:
        """Insert distinct keys that are not there."""
        if 2 * (self.n + len(k)) > len(self.slots):
            old = self.slots != 0
            have, rows = self.slots[old], self.rows[old]
            size = 1 << int(4 * (self.n + len(k))).bit_length()
            self.slots, self.rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(have, rows)
        self._place(k, np.arange(self.n, self.n + len(k), dtype=np.int32))
        self.n += len(k)

    def _place(self, k: np.ndarray, rows: np.ndarray) -> None:
        at, left = self._first(k), np.arange(len(k))
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = k[left[free]]
            won = self.slots[at] == k[left]
            self.rows[at[won]] = rows[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.slots) - 1)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each of the ranges, one range after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def groups_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to at most limit, or that hold one member."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What separates words: the space and the control characters 9 to 13.
SEPARATES = np.zeros(256, bool)
SEPARATES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of documents laid end to end, and how many words each document has."""
    n = len(data)
    gap = SEPARATES[data]
    inner = offsets[1:-1]
    before = np.ones(n + 1, bool)
    before[1:] = np.append(gap[:-1], True) if n else True
    after = np.ones(n, bool)
    after[:-1] = gap[1:]
    before[inner[inner < n]] = True
    after[inner[(inner > 0)] - 1] = True
    starts, ends = np.flatnonzero(~gap & before[:n]), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def release() -> None:
    """Give back to the system what a task has freed. Spark keeps its Python workers, and an idle one would hold that beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def over_batches(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch | pa.Table]], schema: str) -> DataFrame:
    """mapInArrow for a generator of record batches or tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        out = None
        release()

    return frame.mapInArrow(run, schema)
