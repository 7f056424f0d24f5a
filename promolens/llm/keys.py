"""Exact fixed-width keys of short byte spans, and an open-addressing table over them (numpy).

A span of up to 15 bytes becomes two 64-bit numbers: its bytes, zeros, and its length in the last byte. Equal keys are
equal spans, so a hit in the table needs no second look. Longer spans have no key.
"""

from __future__ import annotations

import numpy as np

from promolens.llm.words import U, mix

WIDTH = 15
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1] * 9, np.uint64)


def keys_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half of each span's key; spans must be at most ``WIDTH`` bytes long."""
    padded = np.r_[data, np.zeros(16, np.uint8)]
    view = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    n = end - start
    low = view[start] & _MASK[np.minimum(n, 8)]
    high = view[start + 8] & _MASK[np.maximum(n - 8, 0)]
    return low, high | (n.astype(np.uint64) << U(56))


def spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in one buffer, with their starts and ends."""
    n = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(n)
    return np.frombuffer(b"".join(words), np.uint8), end - n, end


class KeyTable:
    """Distinct keys with a small number each. Its size is fixed by the number of keys; empty slots hold length 0."""

    def __init__(self, low: np.ndarray, high: np.ndarray, value: np.ndarray):
        size = 1 << max(4, (2 * len(low)).bit_length())
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.value = np.zeros(size, value.dtype)
        self.probes = 1
        at, left = self._slots(low, high), np.arange(len(low))
        while len(left):
            free = np.flatnonzero(self.high[at[left]] == 0)
            slot, first = np.unique(at[left[free]], return_index=True)
            won = left[free[first]]
            self.low[slot], self.high[slot], self.value[slot] = low[won], high[won], value[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)
            self.probes += 1

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & U(len(self.low) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where the table has none."""
        at = self._slots(low, high)
        out = np.full(len(low), -1, np.int64)
        left = np.arange(len(low))
        for _ in range(self.probes):
            here = at[left]
            held = self.high[here]
            hit = (held == high[left]) & (self.low[here] == low[left])
            out[left[hit]] = here[hit]
            left = left[~hit & (held != 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.low) - 1)
        return out
