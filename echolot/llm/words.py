"""Words of many texts at once, as NumPy arrays of hashes and offsets.

A word is a longest run of letters and digits, in lower case.  Offsets count
characters of the original text, so a span of words maps back to it at once.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: lower-case code point, 0 where it belongs to no word; and a random 64-bit number."""
    low = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalnum():
            lower = s.lower()
            low[c] = ord(lower) if len(lower) == 1 else c
    return low, mix(low.astype(np.uint64) + np.uint64(1))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = np.array(h, np.uint64)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i in 0..n, modulo 2 ** 64."""
    up, down = _powers.get(int(base), (np.ones(1, np.uint64),) * 2)
    if len(up) <= n:
        size = (int(n) // (1 << 16) + 1) << 16
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, b, np.uint64)))) for b in (base, inverse))
        _powers[int(base)] = up, down
    return up, down


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a line end after each, as code points; and where each begins."""
    flat = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return flat, begins


@dataclass
class Words:
    """row: the text of each word; start, end: its offsets there; hash: of its lower-case letters; first: the first word of each text, and the number of words."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    _sums: np.ndarray
    _at: np.ndarray

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For words longer than n: their places, and the hash of their first n letters."""
        where = np.flatnonzero(self.end - self.start > n)
        at = self._at[where]
        _, down = powers(_BASE, len(self._sums))
        return where, mix((self._sums[at + n] - self._sums[at]) * down[at] + np.uint64(n))


def words(texts: list[str]) -> Words:
    flat, begins = codepoints(texts)
    low, number = tables()
    inside = low[flat] != 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(_BASE, len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(number[flat] * up[: len(flat)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, begins)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(row, starts - begins[row], ends - begins[row], hashes, first, sums, starts)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, whatever text they belong to."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        h = np.zeros(count, np.uint64)
        for i in range(n):
            h = h * _GRAM + hashes[i : i + count]
        return mix(h)
    up, down = powers(_GRAM, len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:count])


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of n words inside a text.  A text of fewer words, but some, has one: all its words."""
    h = windows(w.hash, n)
    rows = w.row[: len(h)]
    keep = rows == w.row[n - 1 :] if len(h) else np.zeros(0, bool)
    rows, h = rows[keep], h[keep]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([windows(w.hash[w.first[i] : w.first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        rows, h = np.concatenate([rows, short]), np.concatenate([h, mix(extra + np.uint64(n))])
        order = np.argsort(rows, kind="stable")
        rows, h = rows[order], h[order]
    return rows, h
