"""Vectorised fingerprints of byte ranges, and the words of many texts at once.

A range's fingerprint is the value of its bytes as a polynomial modulo the prime 2^61 - 1 at one point, drawn once from a
seed. Two different ranges of n bytes agree for at most n of the points, whatever their structure; where a contract
counts equal things within reach of their bytes, Ranges.same compares those too.
"""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_SEED = 20240607
_BASE = int(np.random.default_rng(_SEED).integers(1 << 60, P))
_INVERSE = pow(_BASE, -1, P)
_P, _LOW31, _LOW30 = np.uint64(P), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_1, _30, _31, _61 = (np.uint64(x) for x in (1, 30, 31, 61))
#: Bytes up to which sums of coefficients times half powers stay below 2^64; longer arrays are summed up piecewise.
_PIECE = 1 << 22
#: ASCII white space: the separators between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo P, up to one P too much."""
    return (x & _P) + (x >> _61)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo P."""
    x = _fold(x)
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


def times(high: np.ndarray, low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(high * 2^31 + low) * b modulo P, for high and b below 2^61 and low below 2^31."""
    b_high, b_low = b >> _31, b & _LOW31
    middle = high * b_low + low * b_high
    out = (high * b_high << _1) + (middle >> _30) + ((middle & _LOW30) << _31)
    return _reduce(out + low * b_low)


def _powers(base: int, n: int) -> np.ndarray:
    out, have, step = np.ones(n, np.uint64), 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = times(out[:more] >> _31, out[:more] & _LOW31, np.uint64(step))
        have, step = have + more, step * step % P
    return out


_up = (np.ones(0, np.uint64), np.ones(0, np.uint64))
_down = np.ones(0, np.uint64)


def _scale(n: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Halves of the powers of the point, and powers of its inverse."""
    global _up, _down
    if len(_down) < n:
        size = max(n, 1 << 16)
        up = _powers(_BASE, size)
        _up, _down = (up >> _31, up & _LOW31), _powers(_INVERSE, size)
    return _up, _down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums that begin with 0."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Ranges:
    """Fingerprints of any ranges of one byte array, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self._down = _scale(n + 1)
        self._data = data
        self._prefix = tuple(np.zeros(n + 1, np.uint64) for _ in up)
        #: Sums that were reduced on the way may fall, so differences get one P more.
        self._more = np.uint64(P if n > _PIECE else 0)
        factor = data.astype(np.uint64) + _1
        for prefix, half in zip(self._prefix, up, strict=True):
            for a in range(0, n, _PIECE):
                b = min(n, a + _PIECE)
                np.cumsum(factor[a:b] * half[a:b], out=prefix[a + 1 : b + 1])
                if self._more:
                    prefix[a + 1 : b + 1] = _reduce(_reduce(prefix[a + 1 : b + 1]) + prefix[a])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial values, below 2^61."""
        high, low = (prefix[end] - prefix[start] for prefix in self._prefix)
        if self._more:
            high, low = high + self._more, low + self._more
        # high * 2^31 + low is folded once more into halves below 2^31 + 1 and 2^31.
        high = _fold(high)
        whole = _fold(((high & _LOW30) << _31) + (high >> _30) + _fold(low))
        return times(whole >> _31, whole & _LOW31, self._down[start])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray, step: int = 1 << 22) -> np.ndarray:
        """Whether the length bytes from a equal those from b, by comparing bytes, about step of them at a time."""
        out, ends = np.ones(len(a), bool), sums(length)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + step, "right")) - 1)
            inner = np.arange(ends[j] - ends[i]) - np.repeat(ends[i:j] - ends[i], length[i:j])
            differ = self._data[np.repeat(a[i:j], length[i:j]) + inner] != self._data[np.repeat(b[i:j], length[i:j]) + inner]
            out[i + np.searchsorted(ends[i + 1 : j + 1] - ends[i], np.flatnonzero(differ), "right")] = False
            i = j
        return out

    def classes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first range of each class of equal ranges, and each range's class: found by fingerprints, confirmed on bytes."""
        size = end - start
        _, first, which = np.unique(self.of(start, end), return_index=True, return_inverse=True)
        head = first[which]
        odd = size != size[head]
        odd[~odd] = ~self.same(start[~odd], start[head[~odd]], size[~odd])
        if odd.any():  # equal fingerprints of different ranges: these are told apart by their bytes
            raw, more = self._data.tobytes(), {}
            for i in np.flatnonzero(odd).tolist():
                which[i] = len(first) + more.setdefault(raw[start[i] : end[i]], (len(more), i))[0]
            first = np.concatenate([first, [i for _, i in more.values()]])
        return first, which


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and for each text where its words begin in those arrays (n + 1)."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin, end = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]]
    first[begin] = solid[begin]
    last[end - 1] = solid[end - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def owners(ptr: np.ndarray) -> np.ndarray:
    """The row of each item of a ragged array with row pointers ptr."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
