"""Vectorised words and word shingles of Arrow text columns.

A word is a run of bytes other than space and \\t..\\r; A-Z is folded to a-z. Work goes on
slices of a few MB of text, so memory follows the slice or the longest single text.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 64

def hand_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def frugal(run):
    """run(batches) for mapInArrow, after which the worker hands freed memory back: idle workers live on beside later stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15 | 1)
_STEP = _U(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the bounds of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of at most `limit` bytes, or one row: (first row, rows)."""
    _, bounds = utf8(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


class Words:
    """The words of a slice of texts: bounds in the bytes, row of each, first word of each row."""

    def __init__(self, column: pa.Array, lower: bool = True, table: np.ndarray | None = None):
        data, bounds = utf8(column)
        base, end = int(bounds[0]), int(bounds[-1])
        raw = data[base:end]
        self.bounds = bounds - base
        self.rows = len(column)
        self.bytes = table[raw] if table is not None else _LOWER[raw] if lower else raw
        n = len(self.bytes)
        word = ~_IS_SPACE[self.bytes]
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        first = word.copy()
        last = word.copy()
        if n:
            first[1:] &= ~word[:-1] | edge[1:n]
            last[:-1] &= ~word[1:] | edge[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: words of row i: first[i] .. first[i+1]
        self.first = np.searchsorted(self.starts, self.bounds, "left")
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        lengths = self.ends - self.starts
        h = np.full(len(lengths), 0x243F6A8885A308D3, np.uint64) ^ lengths.astype(np.uint64)
        long = np.flatnonzero(lengths > LONG_WORD)
        live = np.flatnonzero(lengths <= LONG_WORD)
        k = 0
        while len(live):
            live = live[lengths[live] > k]
            h[live] = (h[live] ^ self.bytes[self.starts[live] + k]) * _MULT
            k += 1
        for i in long:
            word = self.bytes[self.starts[i] : self.ends[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return mix64(h)

    def owner(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(self.rows), self.counts)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that start at each word but the last k-1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * _STEP + h[i : len(h) - k + 1 + i]
    return mix64(s)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of fewer words, the whole as one."""
    out: list[np.ndarray] = []
    for _, part in slices(column):
        w = Words(part)
        h = w.hashes()
        s = windows(h, k)
        for i in range(w.rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= k:
                out.append(np.unique(s[a : b - k + 1]))
            else:
                out.append(windows(h[a:b], b - a) if b > a else h[:0])
    return out
