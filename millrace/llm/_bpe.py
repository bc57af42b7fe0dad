"""Byte-level BPE over many texts at once.

Pre-tokens are cut by numpy over code points and looked up by hash in a bounded table; only new ones
are merged by the tokenizer library, so each distinct pre-token is merged about once per worker.
"""

from __future__ import annotations

import json
import sys
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from millrace.llm._words import row_slices, span_hashes, utf8

#: Fixed value: the pre-token pattern of the public vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
#: Code units of text cut at a time.
PIECE_BYTES = 1 << 18


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, as the regex library tells it."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    points[0xD800:0xE000] = 0x41
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[0xD800:0xE000] = OTHER
    return table


def pre_tokens(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. points: code points of texts one after another; bounds: their offsets."""
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    run = np.ones(n, dtype=bool)
    run[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    start = run.copy()
    word = np.flatnonzero(run & (kind != SPACE))  # begins of runs that are not white space
    word = word[word > 0]
    word = word[~edge[word]]
    spaced = word[kind[word - 1] == SPACE]
    start[spaced - 1] = True  # the last white space stands alone or joins what follows
    start[spaced[points[spaced - 1] == 32]] = False
    quote = np.flatnonzero(start & (points == 39))
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1] & (kind[quote + 1] == LETTER)]
    one = points[quote + 1]
    two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
    two[edge[np.minimum(quote + 2, n)]] = 0
    size = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 2, 0))
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    after = quote + 1 + size
    start[after[after < n]] = True
    return start


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts, equal to those of ``Tokenizer.from_file(path)`` without special tokens added."""

    def __init__(self, path: str, slots: int = 1 << 20):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [s.encode() for s in special]
        self.byte_length = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for w, i in ranks.items():
            self.byte_length[i] = len(w)
        for w, i in special.items():
            self.byte_length[i] = len(w.encode())
        self.slots = slots
        self._clear()

    @cached_property
    def whole(self) -> Tokenizer:
        """The library's own tokenizer, loaded only for texts that hold a special token's string."""
        return Tokenizer.from_file(self.path)

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.at = np.zeros(self.slots, dtype=np.int32)
        self.size = np.zeros(self.slots, dtype=np.int32)
        self.pool, self.used, self.filled = np.zeros(1 << 16, dtype=np.int32), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots that hold the hashes, -1 where none does."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, slot, -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            got = self.keys[slot[open_]]
            hit = got == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (got != 0)]
        return out

    def _learn(self, h: np.ndarray, parts: list[bytes]) -> None:
        """Add distinct new hashes; an overfull table starts anew, large enough for them."""
        if self.filled + len(h) > self.slots // 2:
            while len(h) > self.slots // 4:  # only one extremely long text can do this
                self.slots *= 2
            self._clear()
        single = self.merge._core_bpe.encode_single_piece
        ids = [single(p) for p in parts]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.filled += len(h)
        slot, rest = (h & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(rest):
            free = self.keys[slot[rest]] == 0
            self.keys[slot[rest[free]]] = h[rest[free]]
            mine = self.keys[slot[rest]] == h[rest]
            done = rest[mine]
            self.at[slot[done]], self.size[slot[done]] = at[done], size[done]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & (self.slots - 1)

    def _plain(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        if len(points) == len(raw):
            place = np.arange(len(raw) + 1)
        else:
            place = np.append(np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80), len(raw))
            bounds = np.searchsorted(place, bounds)
        starts = np.flatnonzero(pre_tokens(points, bounds))
        ends = np.append(starts[1:], len(points))
        h = span_hashes(points.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x51ED), starts, ends) | np.uint64(1)
        slot = self._find(h)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            left, right = place[starts].tolist(), place[ends].tolist()
            for _ in range(2):  # once more if the table was cleared meanwhile
                new, first = np.unique(h[lost], return_index=True)
                pick = lost[first].tolist()
                self._learn(new, [raw[left[i] : right[i]] for i in pick])
                slot = self._find(h)
                lost = np.flatnonzero(slot < 0)
                if not len(lost):
                    break
        size = self.size[slot].astype(np.int64)
        total = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.pool[np.repeat(self.at[slot] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, bounds)]

    def encode(self, column: pa.Array):
        """For slices of the column: rows lo to hi, their bytes, byte offsets, ids, and offsets of ids."""
        data, offsets = utf8(column)
        for lo, hi in row_slices(offsets, PIECE_BYTES):
            raw = data[offsets[lo] : offsets[hi]].tobytes()
            bounds = offsets[lo : hi + 1] - offsets[lo]
            if any(s in raw for s in self.special):  # a special token's own string: the library decides
                texts = [raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                found = [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
                yield lo, hi, raw, bounds, np.array([i for x in found for i in x], dtype=np.int32), np.cumsum([0, *map(len, found)])
            else:
                ids, at = self._plain(raw, bounds)
                yield lo, hi, raw, bounds, ids, at


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
