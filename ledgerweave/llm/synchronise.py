"""Synchronising positions: a sparse set of places that every copy of a window picks in the same way.

A window is `length` consecutive units (bytes or words). It picks, among the `key`-unit strings inside it, the one
with the smallest hash (the first of equals). The choice depends on the content of the window alone, so two equal windows
pick the same place, at the same offset. Windows that pick one place are neighbours: a *run* of starts `first .. last`
around the place `at`, so a text of n units has about 2 n / (length - key) runs instead of n windows.

Hashes are polynomials modulo 2**64 over random unit values, read from prefix sums, so the hash of any
substring takes constant time. Names of strings are two such hashes with different bases (128 bits).
"""

from __future__ import annotations

import numpy as np

from ledgerweave.llm.once import once

U = np.uint64
#: Two odd bases, fixed for all time: names must agree between tasks and rounds.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Longest piece of a text that is hashed at once; pieces of one text overlap by a window less one unit.
PIECE = 1 << 19
_BITS = 20  # for places inside a piece
_LOW = U((1 << _BITS) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64's finisher)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return once(("powers", base, n), lambda: _make_powers(base, n))


def _make_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, base, dtype=U)
    up[0] = 1
    down = np.full(n, pow(base, -1, 1 << 64), dtype=U)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def byte_values(which: int) -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return once(("bytes", which), lambda: mix(np.arange(1, 257, dtype=U) * U(BASES[1 - which])))


class Prefix:
    """Prefix sums of a sequence of at most PIECE units; `name(s, e)` hashes the units s to e."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.n = len(first)
        size = 1 << max(14, self.n.bit_length())
        self.sums, self.down = [], []
        for base, values in zip(BASES, (first, second)):
            up, down = _powers(base, size)
            total = np.zeros(self.n + 1, dtype=U)
            np.cumsum(values * up[: self.n], out=total[1:])
            self.sums.append(total)
            self.down.append(down)

    def half(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = self.sums[which]
        return (total[end] - total[start]) * self.down[which][start]

    def name(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the substrings; strings of different lengths or salts get different names."""
        extra = mix(np.asarray(end - start, dtype=U) + (np.asarray(salt, dtype=U) << U(24)) + U(1))
        return mix(self.half(0, start, end) + extra), mix(self.half(1, start, end) ^ extra)


def pieces(n: int, length: int):
    """(start, end) of overlapping pieces that together hold every window of a text of n units once."""
    start = 0
    while n - start >= length:
        end = min(n, start + PIECE)
        yield start, end
        start = end - length + 1


def runs(prefix: Prefix, length: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and the first and last window start of each run, in order."""
    n = prefix.n
    if n < length:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    count = n - key + 1
    total = prefix.sums[0]
    order = mix((total[key:] - total[:count]) * prefix.down[0][:count])
    order &= ~_LOW
    order |= np.arange(count, dtype=U)
    span, width = length - key + 1, 1
    while width * 2 <= span:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    if width < span:
        order = np.minimum(order[: len(order) - (span - width)], order[span - width :])
    picked = (order & _LOW).astype(np.int64)
    edge = np.flatnonzero(picked[1:] != picked[:-1]) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge - 1, [len(picked) - 1]])
    return picked[first], first, last
