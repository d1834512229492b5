"""Words of many texts at once: one flat byte buffer per Arrow batch, no loop over words.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Words and runs of words are
told apart by 64-bit hashes, computed with prefix sums over the whole buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are unfolded into arrays at once; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(kind: str, n: int) -> np.ndarray:
    """Powers 0..n of the hash base ("up"), or of its inverse ("down"), modulo 2^64."""
    base = _BASE if kind == "up" else _INVERSE
    low = np.full(4096, base, np.uint64)
    low[0] = 1
    low = np.multiply.accumulate(low)
    high = np.full(n // 4096 + 1, pow(base, 4096, 1 << 64), np.uint64)
    high[0] = 1
    return np.multiply.outer(np.multiply.accumulate(high), low).ravel()[: n + 1]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about PIECE_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """All words of the texts of one array; ``doc`` is the row of each word."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def prefix(self) -> np.ndarray:
        weighted = (self.data.astype(np.uint64) + np.uint64(1)) * powers("up", len(self.data))[: len(self.data)]
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(weighted, out=out[1:])
        return out

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, wherever it stands."""
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])

    @cached_property
    def down(self) -> np.ndarray:
        return powers("down", len(self.data))

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.texts)

    @cached_property
    def first(self) -> np.ndarray:
        """Index of the first word of each text."""
        return np.concatenate(([0], np.cumsum(self.counts)))[:-1]

    def windows(self, n: int) -> np.ndarray:
        """Word indices at which n words of one text begin."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])

    @cached_property
    def rolling(self) -> np.ndarray:
        out = np.zeros(len(self.doc) + 1, np.uint64)
        np.cumsum(self.hashes * powers("up", len(self.doc))[: len(self.doc)], out=out[1:])
        return out

    def window_hash(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each index on: rolling sums over the words' hashes."""
        total = (self.rolling[at + n] - self.rolling[at]) * self.down[at]
        return mix(total + np.uint64(n))

    def per_text(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Number (or sum of integer weights) of marked words in each text."""
        if weights is None:
            return np.bincount(self.doc[at], minlength=self.texts)
        total = np.concatenate(([0], np.cumsum(weights)))
        bounds = np.searchsorted(self.doc[at], np.arange(self.texts + 1))
        return total[bounds[1:]] - total[bounds[:-1]]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of an array of strings; null has none. ``lower`` maps A-Z only."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))
    closes = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, offsets, starts, ends, doc)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text: (row, hash), sorted by both.

    A text with fewer words than n has its whole sequence as one shingle; a text
    without words has none.
    """
    at = w.windows(n)
    row, value = w.doc[at], w.window_hash(at, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        value_of = np.zeros(len(short), np.uint64)
        for k in range(1, n):
            own = w.counts[short] == k
            value_of[own] = w.window_hash(w.first[short[own]], k)
        row, value = np.concatenate((row, short)), np.concatenate((value, value_of))
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    parts = []
    bounds = np.searchsorted(row, np.arange(w.texts + 1))
    for begin, end in zip(bounds[:-1], bounds[1:]):
        part = np.sort(value[begin:end])
        parts.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if end > begin else part)
    sizes = [len(p) for p in parts]
    return np.repeat(np.arange(w.texts), sizes), np.concatenate(parts) if parts else value
