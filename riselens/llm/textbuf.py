"""Words of many texts as numpy arrays.

A batch of texts is laid end to end in one byte buffer, a newline after each.
Word bounds come from a lookup table over bytes, and each word's 64-bit hash
from one prefix sum of a polynomial with random byte values, so the cost per
byte is a few array passes and no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM_ONLY = _SPACE.copy()
_ALNUM_ONLY[[b for b in range(128) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A full-avalanche 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(a: np.ndarray) -> np.ndarray:
    """The sorted distinct values of an integer array; sorting in place of hashing, which is several times slower on long arrays."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


class Words:
    """buf: bytes; start, end: of each word; doc: its text's position; hash: its 64-bit hash; bounds: the first word of each text, and the end."""

    def __init__(self, texts: list[str], lower: bool = False, alnum: bool = False):
        raw = "\n".join(texts) + "\n"
        self.raw = raw.encode("utf-8", "replace")
        buf = np.frombuffer(self.raw, np.uint8)
        self.buf = np.take(_LOWER, buf) if lower else buf
        sizes = np.array([len(t) if t.isascii() else len(t.encode("utf-8", "replace")) for t in texts], np.int64) + 1
        self.text_end = np.cumsum(sizes)
        outside = np.concatenate(([True], np.take(_ALNUM_ONLY if alnum else _SPACE, self.buf), [True]))
        edge = np.flatnonzero(outside[1:] != outside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.bounds = np.searchsorted(self.start, np.concatenate(([0], self.text_end)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        pos, inv = _power(len(buf))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(np.take(_BYTE, self.buf) * pos, dtype=np.uint64, out=total[1:])
        self._total, self._inv = total, inv
        self.hash = mix((total[self.end] - total[self.start]) * inv[self.start]) if len(self.start) else np.zeros(0, np.uint64)

    def sentence(self) -> np.ndarray:
        """Of each word the running number of its sentence; sentences end at . ! ? and line ends."""
        return np.cumsum(_STOP[self.buf])[self.start]

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words of more than ``size`` bytes, and the hashes of their first ``size`` bytes."""
        at = np.flatnonzero(self.end - self.start > size)
        s = self.start[at]
        return at, mix((self._total[s + size] - self._total[s]) * self._inv[s] + np.uint64(size))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def batches(frames, limit: int = 1_000_000):
    """Re-cuts Arrow batches so that one buffer stays small; one text alone may exceed the limit."""
    for pdf in frames:
        size, first = 0, 0
        lengths = pdf["text"].str.len().to_numpy()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield pdf.iloc[first:i]
                size, first = 0, i
            size += n
        if first < len(pdf):
            yield pdf.iloc[first:]
