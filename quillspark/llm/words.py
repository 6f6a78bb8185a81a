"""Words of many texts at once, by their places and hashes, without a Python object for each."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the word hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


_power_cache: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, n of each at least."""
    if not _power_cache or len(_power_cache[0]) < n:
        _power_cache[:] = [np.full(n + n // 4, x, np.uint64) for x in (BASE, BASE_INVERSE)]
        for x in _power_cache:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
    return _power_cache


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of several texts: byte places, document numbers and 64-bit hashes.

    ``table`` maps every byte to itself, to its lower case or to a space. Hashes may collide; what is found by them is compared word by word afterwards.
    """

    def __init__(self, texts: list[bytes | None], table: bytes):
        parts = [(t or b"").translate(table) for t in texts]
        self.data = b" ".join([b"", *parts, b""])
        raw = np.frombuffer(self.data, np.uint8)
        inside = raw != 32
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.begin, self.end = turns[::2], turns[1::2]
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.cuts = np.concatenate(([0], np.searchsorted(self.begin, ends, side="right"))).astype(np.int64)
        powers, backs = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * powers[: len(raw)], out=sums[1:])
        self._sums, self._backs = sums, backs
        self.hashes = self.spans(self.begin, self.end)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes between places."""
        return mix((self._sums[end] - self._sums[begin]) * self._backs[begin])

    def prefixes(self, size: int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the first ``size`` bytes of words, of the whole word if it has no more."""
        begin = self.begin[which]
        return self.spans(begin, np.minimum(begin + size, self.end[which]))

    def word(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]]


def chunks(texts: list, limit: int = 3_000_000):
    """Runs of texts of about ``limit`` bytes together, one text at least."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]
