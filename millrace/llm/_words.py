"""Vectorized words of whole texts, straight from Arrow's UTF-8 buffers.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z: digits, letters
and every byte above 0x7F, so bytes can be classed without decoding.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 18

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C1B  # 3 modulo 8: only one factor of two is lost in differences
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i up to n at least; kept for later calls up to 4 M entries."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, PIECE_BYTES + 2), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 << 20:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (uint64), equal for equal content wherever it stands."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, n)[:n], out=total[1:])
    h = (total[ends] - total[starts]) * powers(_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


@dataclass
class Piece:
    """Some whole texts of a batch: rows lo to hi, their lower-cased bytes, and their words."""

    lo: int
    hi: int
    raw: np.ndarray
    text: np.ndarray
    bounds: np.ndarray  # byte offsets of the texts, hi - lo + 1 of them
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, hi - lo + 1 of them

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.text], self.starts, self.ends)

    @property
    def owner(self) -> np.ndarray:
        """For each word, its text's index in the piece."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


@lru_cache(1)
def _trim():
    """glibc's call that gives freed memory back; elsewhere nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def row_slices(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi
    _trim()(0)  # workers live on between tasks: they should not hold what one batch needed


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    data, offsets = utf8(column)
    for lo, hi in row_slices(offsets, limit):
        raw = data[offsets[lo] : offsets[hi]]
        bounds = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        text = FOLD[raw]
        inside = IS_WORD[text]
        edge = np.zeros(len(text) + 1, dtype=bool)
        edge[bounds] = True
        begins, stops = inside.copy(), inside.copy()
        if len(text):
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            stops[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        yield Piece(lo, hi, raw, text, bounds, starts, ends, np.searchsorted(starts, bounds))


_STEPS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and each text's offset in them.

    A text of fewer than k words, but not none, has one shingle of all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(n, out=at[1:])
    begin = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    if len(hashes) == 0:
        return np.zeros(0, np.uint64), at
    out = np.zeros(at[-1], dtype=np.uint64)
    last = np.repeat(first[1:], n)
    for j in range(k):
        p = begin + j
        ok = p < last
        out += np.where(ok, hashes[np.minimum(p, len(hashes) - 1)] * _STEPS[j], np.uint64(0))
    return mix(out), at
