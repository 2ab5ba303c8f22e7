"""Vectorised handling of whole texts: words, word hashes and shingles over Arrow columns, without a Python loop per word.

A word is a maximal run of bytes other than space and U+0009 to U+000D. In UTF-8 those six bytes occur
only as themselves, so the rule on bytes equals the rule on characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text is handled in slices of about so many bytes, which bounds a worker's memory; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_U = np.uint64


_Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[_Batches], _Batches]) -> Callable[[_Batches], _Batches]:
    """run, for mapInArrow, with freed memory handed back to the system at its end: a worker outlives its task, and what allocators keep would add up over the stages."""

    def task(batches: _Batches) -> _Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
                trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `size` bytes."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and each text's offset; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a slice: byte ranges `start`..`end`, a 64-bit `hash` each, and `first`, each text's first word (one more entry than texts)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, off = raw(column)
        if lower:
            # in arithmetic, which is quicker than a table
            data = data | ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
        self.data, self.offsets = data, off
        n = len(data)
        inside = (data - np.uint8(9)) > 4
        inside &= data != 32
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            edge = off[:-1][off[:-1] < n]
            begin[edge] = inside[edge]
            last = off[1:][off[1:] > 0] - 1
            end[last] = inside[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
        out = mix((eight[self.start] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
        rest, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(rest):
            part = eight[self.start[rest] + k] & _KEEP[np.minimum(size[rest] - k, 8)]
            out[rest] = mix((out[rest] * _U(0x9E3779B97F4A7C15)) ^ part)
            k += 8
            rest = rest[size[rest] > k]
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of k words within one text start, and a hash of each run."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        stop = np.repeat(self.first[1:], self.counts())[:n]
        at = np.flatnonzero(np.arange(n) + k <= stop)
        return at, gram_hashes(self.hash, k)[at]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k entries, at its first."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = mix(words[:n] + _U(k))
    for j in range(1, k):
        h = mix(h * _U(0x9E3779B97F4A7C15) + words[j : j + n])
    return h


def ragged_unique(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, sorted, and the n + 1 offsets of the owners; `owner` ascends."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.uint64).view(np.int64)
