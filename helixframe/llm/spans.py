"""Words of many texts at once: byte spans, 64-bit hashes and hashes of word windows, all vectorised.

A word is a maximal run of bytes other than space and 0x09-0x0D; in UTF-8 no other character holds those bytes.
Hashes are polynomials over a seeded byte table modulo 2^64, finished by a mixer, so equal words have equal hashes
on every machine and Python version.
"""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    edge = np.empty(len(buf) + 1, bool)
    word = ~_WHITE[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # in blocks, so that the tables of powers stay small whatever the length of the text
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        s, e = starts[first:last] - low, ends[first:last] - low
        n = int(e[-1])
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf[low : low + n]] * up[:n], out=sums[1:])
        out[first:last] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = last
    return mixed(out)


def window_hashes(words: np.ndarray, k: int, factor: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 have none."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(factor) + words[j : j + n]
    return mixed(out)


class Texts:
    """The words of some texts, laid end to end."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8)
        self.starts, self.ends = word_spans(self.buf)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        #: First word of each text, and the number of words.
        self.first = np.searchsorted(self.starts, at)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.buf, self.starts, self.ends)

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its number within its text, and the number of words of that text."""
        count = np.repeat(self.count, self.count)
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.count), count
