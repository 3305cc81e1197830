"""Words of whole texts as numpy arrays: positions, hashes of words and of runs of words.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. In UTF-8 these six never occur inside a longer character, so bytes give the same words as
characters do. All functions take the texts of one Arrow slice; null counts as empty.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21  # texts handled at once; one longer text makes a slice of its own

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_SECOND = 0xD6E8FEB86659FD93


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for models and tables built once."""
    return sys.__dict__.setdefault("_ringlens_llm_store", {})


def worker_model(kind: str, name: str, build):
    """The worker's model of a kind: built once per name; another name takes its place."""
    store = worker_store()
    if store.get(kind, ("",))[0] != name:
        store.pop(kind, None)
        store[kind] = name, build()
    return store[kind][1]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``limit`` bytes; no row is lost or split."""
    for batch in batches:
        ends = text_bytes(batch.column(column))[1][1:]
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()  # the worker lives on beside others


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets between them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (an invertible finaliser)."""
    v = values ^ (values >> np.uint64(30))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v = v * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _powers(count: int, base: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64, kept for the next slice."""
    known = worker_store().get(("powers", base))
    if known is None or len(known) < count:
        steps = np.full(max(count, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        known = worker_store()[("powers", base)] = np.multiply.accumulate(steps)
    return known[:count]


class Words:
    """Word positions of the texts in one column of a slice.

    ``first[i] : first[i + 1]`` are the words of text i; ``starts`` and ``ends`` are byte positions.
    """

    def __init__(self, column: pa.Array) -> None:
        self._find(*text_bytes(column), IS_SPACE)

    def _find(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> None:
        """Cut the texts where bytes are ``between`` words."""
        self.data, self.offsets = data, offsets
        inside = ~between[self.data]
        before = np.zeros(len(inside) + 1, dtype=bool)
        before[1:] = inside
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        begins = inside & ~before[:-1]
        begins[cuts] = inside[cuts]
        finishes = before.copy()
        finishes[:-1] &= ~inside
        finishes[cuts] = before[cuts]
        finishes[0] = False
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes)
        self.first = np.searchsorted(self.starts, self.offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Count the set bytes of each text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, taken eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((max(len(padded) - 7, 1),), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    result = mix(length.astype(np.uint64) + np.uint64((_MULTIPLIER + salt) % (1 << 64)))
    at, left, rows = starts, length, slice(None)
    while len(at):
        lane = lanes[at]
        short = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        keep = np.where(short == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short % np.uint64(64))) - np.uint64(1))
        result[rows] = mix((result[rows] ^ (lane & keep)) * np.uint64(_MULTIPLIER))
        more = np.flatnonzero(left > 8)
        rows = more if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return result


class RunHashes:
    """Hashes of any run of consecutive words, from prefix sums over the word hashes."""

    def __init__(self, hashes: np.ndarray, second: bool = False) -> None:
        base = _SECOND if second else _MULTIPLIER
        self.powers = _powers(len(hashes) + 1, base)
        self.inverse = _powers(len(hashes) + 1, pow(base, -1, 1 << 64))
        self.total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.powers[:-1], out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))
