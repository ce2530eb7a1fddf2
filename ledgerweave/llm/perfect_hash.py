"""Minimal perfect hashing in numpy: n distinct 128-bit keys get the places 0 .. n-1, in about four bits a key.

Keys are hashed into a bit array twice their number; a key alone in its bit is done, the others go to a smaller
array of their own, until none is left. A key's place is the number of set bits before its own. Keys that were not
built in get no place, or one of another key: whoever asks compares fingerprints.
"""

from __future__ import annotations

import numpy as np

from ledgerweave.llm.synchronise import U, mix

#: Bits of a level for each key that is left.
ROOM = 2


def _bit(first: np.ndarray, second: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(first ^ mix(second + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) % U(bits)).astype(np.int64)


def build(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all levels, and how many words each level has. The pairs (first, second) must be distinct."""
    words, sizes = [np.zeros(0, dtype=U)], []
    while len(first):
        size = -(-ROOM * len(first) // 64)
        bit = _bit(first, second, len(sizes), size * 64)
        alone = np.bincount(bit, minlength=size * 64) == 1
        words.append(np.packbits(alone, bitorder="little").view(U))
        sizes.append(size)
        rest = ~alone[bit]
        first, second = first[rest], second[rest]
    return np.concatenate(words), np.array(sizes, dtype=np.int64)


def places(words: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The place of each key; -1 where no level has its bit."""
    before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
    out = np.full(len(first), -1, dtype=np.int64)
    live, base = np.arange(len(first)), 0
    for level, size in enumerate(sizes.tolist()):
        bit = _bit(first[live], second[live], level, size * 64)
        word, shift = base + (bit >> 6), (bit & 63).astype(U)
        value = words[word]
        on = (value >> shift & U(1)) == 1
        below = np.bitwise_count(value[on] & ((U(1) << shift[on]) - U(1)))
        out[live[on]] = before[word[on]] + below
        live, base = live[~on], base + size
    return out
