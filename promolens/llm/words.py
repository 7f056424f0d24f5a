"""Vectorised words and word windows of Arrow text columns (numpy, no per-word Python).

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Hashes are 64-bit polynomial sums over
random byte codes, finished by a mixer; ``seed`` selects independent families.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD_BLANKS = _SPACE
#: White space, ASCII punctuation and digits.
NO_LETTERS = _SPACE.copy()
NO_LETTERS[33:65] = NO_LETTERS[91:97] = NO_LETTERS[123:128] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for s in (11, 12)]
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to n."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 64)
        out = []
        for base in (_BASES[seed], pow(_BASES[seed], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        have = (out[0], out[1])
        if size <= 4 * SLICE_BYTES:  # what one huge document needs is not kept
            _powers[seed] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def sliced(table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes (or one longer row)."""
    _, off = text_bytes(table.column(column))
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
    pa.default_memory_pool().release_unused()


class Words:
    """Words of consecutive rows: byte spans ``start``/``end`` and ``first[i]:first[i+1]`` as the words of row i."""

    def __init__(self, column, lower: bool = False, blank: np.ndarray = WORD_BLANKS):
        self.data, self.off = text_bytes(column)
        if lower:
            self.data = _LOWER[self.data]
        data, off = self.data, self.off
        solid = ~blank[data]
        begin, end = solid.copy(), solid.copy()
        if len(data):
            begin[1:] &= ~solid[:-1]
            end[:-1] &= ~solid[1:]
            filled = np.flatnonzero(np.diff(off))
            begin[off[filled]] = solid[off[filled]]
            end[off[filled + 1] - 1] = solid[off[filled + 1] - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0, heads: tuple = ()) -> np.ndarray:
        """Hash of each word. With ``heads`` also of the words' first k bytes, for each k: a list of such arrays;
        shorter words have their own hash there."""
        n = len(self.data)
        up, down = powers(seed, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[seed][self.data] * up[:n], out=total[1:])

        def of(end, salt=0):
            h = (total[end] - total[self.start]) * down[self.start]
            return mix(h + (end - self.start).astype(np.uint64) * U(0xD6E8FEB86659FD93) + U(salt))

        own = of(self.end)
        if not heads:
            return own
        return [own, *(np.where(self.end - self.start > k, of(np.minimum(self.end, self.start + k), k), own) for k in heads)]

    def windows(self, h: np.ndarray, w: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``w`` words within one row, in order."""
        at = self.window_starts(w)
        return at, window_hash(h, at, w, seed)

    def window_starts(self, w: int) -> np.ndarray:
        count = np.maximum(np.diff(self.first) - (w - 1), 0)
        total = int(count.sum())
        shift = np.repeat(self.first[:-1] - (np.cumsum(count) - count), count)
        return np.arange(total) + shift


def window_hash(h: np.ndarray, at: np.ndarray, w: int, seed: int = 0) -> np.ndarray:
    up, down = powers(seed, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[at + w] - total[at]) * down[at] + U(w * 0xA0761D6478BD642F % 2**64))
