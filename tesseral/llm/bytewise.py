"""Texts as one array of bytes: word spans and their 64-bit hashes without a Python object for each word.

The hash of a span is a polynomial in its bytes modulo 2**64, with a random value for each byte, taken from prefix sums;
a finaliser mixes in the length. It depends on the span's bytes alone, so all workers agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Spans are hashed in windows of about so many bytes, so that memory doesn't follow the longest text.
WINDOW = 1 << 17
_P = 0x9E3779B97F4A7C15
_UP = np.uint64(_P)
_DOWN = np.uint64(pow(_P, -1, 1 << 64))
PLAIN = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLDED = PLAIN[LOWER]  # a hash that doesn't tell A-Z from a-z
BREAK = np.zeros(256, dtype=bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near inputs get unrelated hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers[0]):
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_UP, _DOWN)):
            new = np.full(size, base, np.uint64)
            new[0] = 1
            _powers[i] = np.multiply.accumulate(new)
    return _powers[0], _powers[1]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each begins and the last ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the spans between ASCII white space, and the number of each text's first one, then of all."""
    gap = BREAK[data]
    opens, closes = ~gap, ~gap
    opens[1:] &= gap[:-1]
    closes[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner], closes[inner - 1] = ~gap[inner], ~gap[inner - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = PLAIN) -> np.ndarray:
    """A hash for each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + WINDOW, side="right")))
        part = data[base : int(ends[to - 1])]
        up, down = _powers_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _UP
        at = to
    return mixed(out)


class HashTable:
    """Numbers by 64-bit keys, with open addressing; many are looked up, or added, at once. Keys are never 0."""

    def __init__(self, columns: int, bits: int = 16):
        self.columns = columns
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = [np.zeros(1 << bits, np.int32) for _ in range(self.columns)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it is not there."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        met = self.keys[slot]
        out = np.where(met == keys, slot, -1)
        open_ = np.flatnonzero((met != keys) & (met != 0))
        mask = (1 << self.bits) - 1
        while len(open_):
            at = (slot[open_] + 1) & mask
            slot[open_] = at
            met, want = self.keys[at], keys[open_]
            hit = met == want
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (met != 0)]
        return out

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        """Keys that are distinct and not there yet."""
        if 5 * (self.count + len(keys)) > 3 << self.bits:
            old = np.flatnonzero(self.keys)
            held, held_values = self.keys[old], [v[old] for v in self.values]
            bits = self.bits
            while 5 * (self.count + len(keys)) > 3 << bits:
                bits += 1
            self._make(bits)
            self._place(held, held_values)
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values) -> None:
        self.count += len(keys)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left, mask = np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several, the last stays
            won = self.keys[at] == keys[left]
            for column, value in zip(self.values, values, strict=True):
                column[at[won]] = value[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask
