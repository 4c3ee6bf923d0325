"""Elias-Fano sequences and packed integers over numpy arrays, for memory-mapped use.

A sequence of n increasing values below u keeps the lower l = log2(u / n) bits of each side by
side, and the upper parts in unary: a one for each value, a zero for each step. Everything is 64-bit
words, so a sequence can be read straight from a mapped file.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

U64 = np.uint64
ALL = U64(0xFFFFFFFFFFFFFFFF)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, side by side (and a word of padding)."""
    out = np.zeros(len(values) * bits // 64 + 2, U64)
    if bits and len(values):
        v = values.astype(U64)
        at = np.arange(len(v), dtype=U64) * U64(bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        over = shift + U64(bits) > 64
        # values that begin in one word have bits of their own, so sums are unions
        out += _sums(word, v << shift, len(out))
        out += _sums(word[over] + 1, v[over] >> (U64(64) - shift[over]), len(out))
    return out


def _sums(where: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, U64)
    if len(where):
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        out[where[first]] = np.bitwise_or.reduceat(v, first)
    return out


def unpack(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), U64)
    at = i.astype(U64) * U64(bits)
    word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
    high = np.where(shift > 0, words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return ((words[word] >> shift) | high) & (ALL >> U64(64 - bits))


def _places() -> np.ndarray:
    """Place of the k-th one of a byte, at 8 * byte + k."""
    out = np.zeros(256 * 8, np.int64)
    for byte in range(256):
        ones = [i for i in range(8) if byte >> i & 1]
        out[8 * byte : 8 * byte + len(ones)] = ones
    return out


PLACES = _places()
#: Each byte, pair, nibble or sign bit of a word.
BYTES, PAIRS, FOURS, NIBBLES, SIGNS = (U64(int(x * (16 // len(x)), 16)) for x in ("01", "5", "3", "0f", "80"))


def select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th one (zero, if ``flip``) bit; before: how many there are before each word.

    Within a word: running sums of its bytes' ones, side by side, tell the byte, and a table the place there.
    """
    w = np.searchsorted(before, k, "right") - 1
    left = (k - before[w]).astype(U64)
    x = ~words[w] if flip else words[w]
    sums = x - ((x >> U64(1)) & PAIRS)
    sums = (sums & FOURS) + ((sums >> U64(2)) & FOURS)
    sums = ((sums + (sums >> U64(4))) & NIBBLES) * BYTES
    passed = (((left * BYTES) | SIGNS) - sums) & SIGNS  # bytes up to which there are k ones or fewer
    bit = np.bitwise_count(passed).astype(U64) << U64(3)
    left -= ((sums << U64(8)) >> bit) & U64(255)
    place = PLACES[((((x >> bit) & U64(255)) << U64(3)) | left).astype(np.int64)]
    return w * 64 + bit.astype(np.int64) + place


def after(words: np.ndarray, before: np.ndarray, k: np.ndarray, at: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the bit next to the k-th, whose place is ``at``: mostly in the same word."""
    w = at >> 6
    x = ~words[w] if flip else words[w]
    rest = x & ((ALL << U64(1)) << (at & 63).astype(U64))
    out = (w << 6) + np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
    far = np.flatnonzero(rest == 0)
    if len(far):
        out[far] = select(words, before, k[far] + 1, flip)
    return out


class EliasFano:
    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray):  # noqa: E741
        self.n, self.l, self.low, self.high = n, l, low, high

    @cached_property
    def ones(self) -> np.ndarray:
        """Ones before each word; made when the sequence is first asked."""
        ones = np.bitwise_count(self.high).astype(np.int64)
        return np.cumsum(ones) - ones

    @cached_property
    def zeros(self) -> np.ndarray:
        return np.arange(len(self.high), dtype=np.int64) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        l = min(63, max(0, (universe // n).bit_length() - 1)) if n else 0  # noqa: E741
        v = values.astype(U64)
        top = (v >> U64(l)).astype(np.int64)
        bits = top + np.arange(n)
        size = (n + (universe >> l) + 2) // 64 + 2
        high = _sums(bits >> 6, U64(1) << (bits & 63).astype(U64), size) if n else np.zeros(size, U64)
        return cls(n, l, pack(v & ((U64(1) << U64(l)) - U64(1)), l), high)

    def words(self) -> list[np.ndarray]:
        return [np.array([self.n, self.l, len(self.low), len(self.high)], U64), self.low, self.high]

    @classmethod
    def view(cls, words: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, l, a, b = (int(x) for x in words[at : at + 4])  # noqa: E741
        at += 4
        return cls(n, l, words[at : at + a], words[at + a : at + a + b]), at + a + b

    def get(self, i: np.ndarray) -> np.ndarray:
        return self._value(i, select(self.high, self.ones, i, False))

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - i).astype(U64) << U64(self.l)) | unpack(self.low, self.l, i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and i + 1."""
        at = select(self.high, self.ones, i, False)
        return self._value(i, at), self._value(i + 1, after(self.high, self.ones, i, at, False))

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value (within begin to end), or -1: the successor search goes by the upper bits, then by halving along the lower ones."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        v = values.astype(U64)
        top = (v >> U64(self.l)).astype(np.int64)
        low = v & ((U64(1) << U64(self.l)) - U64(1))
        # the ones before a zero: its place less the zeros before it
        zero = select(self.high, self.zeros, np.maximum(top - 1, 0), True)
        i = np.where(top > 0, zero - (top - 1), 0)
        stop = np.where(top > 0, after(self.high, self.zeros, np.maximum(top - 1, 0), zero, True), zero) - top
        if begin is not None:
            i, stop = np.maximum(i, begin), np.minimum(stop, end)
        # halving among the values with these upper bits, as a frequent context has many
        live = np.flatnonzero(i < stop)
        low, first, last = low[live], i[live], stop[live]
        active = np.flatnonzero(last - first > 1)
        while len(active):
            a, b = first[active], last[active]
            mid = (a + b) >> 1
            upto = unpack(self.low, self.l, mid) <= low[active]
            first[active] = a = np.where(upto, mid, a)
            last[active] = b = np.where(upto, b, mid)
            active = active[b - a > 1]
        hit = unpack(self.low, self.l, first) == low
        out[live[hit]] = first[hit]
        return out
