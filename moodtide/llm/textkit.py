"""Vectorised words, hashes and distinct shingle sets over the UTF-8 bytes of whole Arrow batches.

Every separator class is ASCII, so that work on bytes equals work on code points. A batch is cut into
slices of a bounded number of bytes (one longer text is a slice of its own): temporary arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
_RNG = np.random.default_rng(20240117)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

ALL = np.ones(256, bool)
#: Complement of \x20 and \x09-\x0D.
BLANK_SEPARATED = ALL.copy()
BLANK_SEPARATED[[32, 9, 10, 11, 12, 13]] = False
#: Digits, lower-case letters and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    held = _powers.get(int(base))
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = U(pow(int(base), -1, 2**64))
        both = []
        for b in (base, inverse):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        held = both[0], both[1]
        if size <= 4 << 20:  # longer ones serve one long text and go
            _powers[int(base)] = held
    return held


def forget() -> None:
    """Drops tables that are made again when they are needed."""
    _powers.clear()


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit polynomial hash of each run values[start:end]; the run's length is part of it."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * U(0x9FB21C651E98DF25))


class Texts:
    """Some texts of a batch: data holds their bytes one after another, offs where each begins."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int, lower: bool = False):
        self.data, self.offs, self.first = _LOWER[data] if lower else data, offs, first
        self.n = len(offs) - 1

    def spans(self, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal runs of bytes of a class; runs end at text borders and before cuts."""
        on = inside[self.data]
        if not len(on):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        border = np.zeros(len(on) + 1, bool)
        border[self.offs] = True
        if cuts is not None:
            border[cuts] = True
        before, after = np.empty_like(on), np.empty_like(on)
        before[0], before[1:] = False, on[:-1]
        after[-1], after[:-1] = False, on[1:]
        return np.flatnonzero(on & (~before | border[:-1])), np.flatnonzero(on & (~after | border[1:])) + 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return run_hash(_BYTE[self.data], start, end)

    def word_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes, eight bytes at a time: of short words work grows with the words. It differs from that of ``hashes``."""
        eight = np.ndarray(len(self.data) + 1, "<u8", np.append(self.data, np.zeros(8, np.uint8)), strides=(1,))
        left = end - start
        h = mix((eight[start] & _FIRST[np.minimum(left, 8)]) + left.astype(np.uint64) * _STEP)
        more, at = np.flatnonzero(left > 8), 8
        while len(more):
            rest = left[more] - at
            h[more] = mix(h[more] * _BASE + (eight[start[more] + at] & _FIRST[np.minimum(rest, 8)]))
            more, at = more[rest > 8], at + 8
        return h

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end and text of the \n-separated lines of all texts, empty ones too."""
        breaks = np.flatnonzero(self.data == 10)
        own = np.repeat(np.arange(self.n), 1 + np.diff(np.searchsorted(breaks, self.offs)))
        return np.sort(np.concatenate([self.offs[:-1], breaks + 1])), np.sort(np.concatenate([breaks, self.offs[1:]])), own

    def points(self) -> np.ndarray:
        """Code points before each byte, and of all at the end."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column in slices of about limit bytes; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield Texts(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at, lower)
        at = to


def windows(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of k words of one owner."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: len(words) - k + 1] == owner[k - 1 :])
    h = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        h = h * _STEP + words[j : len(words) - k + 1 + j]
    return mix(h[at] + U(k)), at


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] values), start[1], ..."""
    ends = np.cumsum(length)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(np.asarray(start, np.int64) - ends + length, length)


def bounds(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each of the owners 0..n-1 begins in a sorted owner column, and the end."""
    return np.searchsorted(owner, np.arange(n + 1))


def shingle_sets(words: np.ndarray, owner: np.ndarray, n: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each owner, sorted: values, and where each owner's begin.

    An owner of fewer words has one shingle, its whole sequence; one without words has none.
    """
    return sorted_sets(*shingles(words, owner, n, k), n)


def shingles(words: np.ndarray, owner: np.ndarray, n: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The same with repeats and in no order: values and owners."""
    h, at = windows(words, owner, k)
    own = owner[at]
    begin = bounds(owner, n)
    count = np.diff(begin)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = run_hash(words, begin[few], begin[few + 1], _STEP)
        h, own = np.concatenate([h, short]), np.concatenate([own, few])
    return h, own


def sorted_sets(h: np.ndarray, own: np.ndarray, n: int, where: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct values of each owner, sorted, and where each owner's begin; with where, the place of each in h too."""
    order = np.argsort(h)
    by = own[order]
    order = order[np.argsort(by.astype(np.uint16) if n < 65536 else by, kind="stable")]
    h, own = h[order], own[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own, order = h[new], own[new], order[new]
    return (h, bounds(own, n), order) if where else (h, bounds(own, n))


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of values[begin[i]:begin[i + 1]]; modular for unsigned values."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]
