"""Elias-Fano coding of monotone sequences, and vectorised search in the coded form.

A value of a sequence of n values below u is split: its l = floor(log2(u / n)) low bits stand in packed fields, the rest as
unary gaps in a bit vector of about 2 n bits. A sequence is a flat byte string (header, low words, high words), so that it can be read in place from a
memory-mapped file; counts of ones before each 64-bit word are made when it is opened.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SHIFTS = tuple(U(s) for s in (32, 16, 8, 4, 2, 1))


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of width bits one after another in 64-bit words, and a word of padding."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 1, U)
    if width and n:
        bit = np.arange(n, dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(U)
        first = np.append(0, np.flatnonzero(np.diff(word)) + 1)
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((bit & 63) + width > 64)
        out[word[over] + 1] |= values[over] >> (U(64) - shift[over])
    return out


def encode(values: np.ndarray) -> bytes:
    """A sequence of non-decreasing unsigned numbers."""
    values = np.asarray(values, U)
    n = len(values)
    low_bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
    low = values & U((1 << low_bits) - 1)
    high = (values >> U(low_bits)).astype(np.int64) if low_bits < 64 else np.zeros(n, np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    bits = np.zeros((size + 63) // 64 * 64 + 64, np.uint8)
    bits[high + np.arange(n)] = 1
    high_words = np.packbits(bits, bitorder="little").view("<u8")
    low_words = _pack(low, low_bits)
    return b"".join(x.astype("<u8").tobytes() for x in (np.array([n, low_bits, len(low_words), len(high_words)], U), low_words, high_words))


class Sequence:
    """A coded sequence at an offset of a buffer; the words are views into it."""

    def __init__(self, buffer, offset: int = 0):
        n, bits, lows, highs = (int(x) for x in np.frombuffer(buffer, "<u8", 4, offset))
        self.n, self.bits = n, bits
        self.low = np.frombuffer(buffer, "<u8", lows, offset + 32)
        self.high = np.frombuffer(buffer, "<u8", highs, offset + 32 + 8 * lows)
        self.end = offset + 32 + 8 * (lows + highs)
        self.ones = np.zeros(highs + 1, np.int64)
        np.cumsum(np.bitwise_count(self.high), out=self.ones[1:])
        self.zeros = 64 * np.arange(highs + 1, dtype=np.int64) - self.ones

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros of the high bits."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        w = self.high[word] if one else ~self.high[word]
        left = (k - before[word]).astype(U)
        at = np.zeros(len(k), U)
        for s in _SHIFTS:
            c = np.bitwise_count((w >> at) & ((U(1) << s) - U(1))).astype(U)
            on = left >= c
            left -= np.where(on, c, U(0))
            at += np.where(on, s, U(0))
        return 64 * word + at.astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        bit = i * self.bits
        word, shift = bit >> 6, (bit & 63).astype(U)
        up = (self.low[word + 1] << (U(63) - shift)) << U(1)
        return ((self.low[word] >> shift) | up) & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, U)
        return ((self._select(i, True) - i).astype(U) << U(self.bits)) | self._lows(i)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the first values that aren't below each x among those with its high bits, where these end, and the low bits of x."""
        bucket, low = (x >> U(self.bits)).astype(np.int64), x & U((1 << self.bits) - 1)
        beyond = (bucket >= int(self.zeros[-1])) | (bucket < 0)  # no value has such high bits; the vector ends with zeros
        bucket[beyond] = int(self.zeros[-1]) - 1
        begin = self._select(np.maximum(bucket - 1, 0), False) + 1 - bucket
        begin[bucket == 0] = 0
        end = self._select(bucket, False) - bucket
        at, to = begin.copy(), end.copy()
        live = np.flatnonzero(at < to)
        while len(live):
            middle = (at[live] + to[live]) >> 1
            less = self._lows(middle) < low[live]
            at[live[less]] = middle[less] + 1
            to[live[~less]] = middle[~less]
            live = live[at[live] < to[live]]
        return at, end, low

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that isn't below each x; n where all are."""
        x = np.asarray(x, U)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values x, and which of them occur; the place of one that doesn't is 0."""
        x = np.asarray(x, U)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at, end, low = self._search(x)
        known = at < end
        known[known] = self._lows(at[known]) == low[known]
        return np.where(known, at, 0), known
