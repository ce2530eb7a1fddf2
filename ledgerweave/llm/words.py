"""Words of many texts at once, as 128-bit names computed on the bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ledgerweave.llm.synchronise import Prefix, U, byte_values, mix

SEGMENT = 1 << 17

#: Bytes 0x20 and 0x09-0x0D part words; all others belong to one.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Digits, lower-case letters and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


@dataclass
class Words:
    """Words of a list of texts: names, bytes of each word in `joined`, and where each text's words begin and end."""

    first: np.ndarray
    second: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    joined: bytes

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def words_of(texts: list[bytes], is_word: np.ndarray, names: bool = True) -> Words:
    """Words of all texts. Texts of any length are hashed in segments cut between words."""
    joined = b" ".join(texts)
    buffer = np.frombuffer(joined, dtype=np.uint8)
    inside = is_word[buffer]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.concatenate([[0], np.cumsum([len(text) + 1 for text in texts], dtype=np.int64)])
    offsets = np.searchsorted(starts, begin)
    first, second = (np.zeros(len(starts) if names else 0, dtype=U) for _ in range(2))
    at = 0
    while names and at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
        low, high = starts[at], ends[upto - 1]
        part = buffer[low:high]
        prefix = Prefix(byte_values(0)[part], byte_values(1)[part])
        first[at:upto], second[at:upto] = prefix.name(starts[at:upto] - low, ends[at:upto] - low)
        at = upto
    return Words(first, second, starts, ends, offsets, joined)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of all runs of `width` values."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=U)
    total = np.zeros(count, dtype=U)
    for step in range(width):
        total = (total + values[step : step + count]) * U(0x9E3779B97F4A7C15)
        total ^= total >> U(29)
    return mix(total)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie inside one of the windows of `width` places that begin at `starts`."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of word values by text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
