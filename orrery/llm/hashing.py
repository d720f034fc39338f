"""Polynomial prefix hashes of byte strings, computed for many substrings at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Prefix hashes restart after so many bytes at most, unless one text is longer.
BUFFER = 4 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that scatters all bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64), 7)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n places at least."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(out, out=out)
            _powers[k] = out
    return _powers[0], _powers[1]


class Prefix:
    """Prefix hashes of ``data``; ``of(start, end)`` hashes substrings alike wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self._down[start]

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` bytes, in order."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[width:] - self.sums[:n]) * self._down[:n]


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.

    Letters A-Z are lowered; words are runs of anything but space and U+0009 to U+000D. A shingle is ``width`` words; with
    fewer, but some, the whole sequence is the one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(data)]])
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    h = mix(Prefix(data).of(starts, ends) ^ mix((ends - starts).astype(np.uint64), 3))
    return np.unique(h)
