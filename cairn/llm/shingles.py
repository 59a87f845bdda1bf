"""Hashes of word shingles of many texts at once, and the sketches made of them, in numpy.

Words are what stands between bytes 09-0D and 20, with A-Z lower-cased. A word's hash is a polynomial
over its bytes modulo 2^64, taken as a difference of running sums, then mixed; a shingle's is a
polynomial over the hashes of its words, mixed again. Nothing here loops over words in Python.

A text of fewer words than a shingle is one shingle of all its words; one without words has none.
Texts of any length are read in pieces of PIECE bytes, cut at white space.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Byte values from 1 on, with A-Z as a-z.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """The base's powers and their inverses, n of each at least."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and how many each text has."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    found, starts, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(buffer):
        hi = min(len(buffer), lo + PIECE)
        while not _BLANK[buffer[hi - 1]]:  # the last byte is blank
            after = np.flatnonzero(_BLANK[buffer[hi : hi + PIECE]])
            hi = hi + int(after[0]) + 1 if len(after) else min(len(buffer), hi + PIECE)
        part = buffer[lo:hi]
        blank = _BLANK[part]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        edge = edge if blank[0] else np.r_[0, edge]
        start, end = edge[0::2], edge[1::2]
        power, inverse = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=sums[1:])
        found.append(mixed((sums[end] - sums[start]) * inverse[start]))
        starts.append(start + lo)
        lo = hi
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(starts), first))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of k words, text after text, repeats included, and how many each text has."""
    n, ends = len(words), np.cumsum(counts)
    padded, h = np.concatenate([words, np.zeros(k, np.uint64)]), np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _STEP + padded[j : j + n]
    starts, real = np.ones(n, bool), counts > 0
    for j in range(1, k):
        starts[(ends - j)[counts >= j]] = False
    for i in np.flatnonzero(real & (counts < k)).tolist():
        lo, value = int(ends[i] - counts[i]), 0
        for w in words[lo : ends[i]].tolist():
            value = (value * int(_STEP) + w + 1) % (1 << 64)
        starts[lo], h[lo] = True, value
    return mixed(h[starts]), np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))


def simhashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is set if set in over half of a text's shingles."""
    out, ends = np.zeros(len(counts), np.uint64), np.cumsum(counts)
    for i, (hi, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        ones = np.zeros(64, np.int64)
        for lo in range(hi - n, hi, 1 << 16):
            part = np.ascontiguousarray(hashes[lo : min(hi, lo + (1 << 16))])
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out[i] = np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]
    return out


class MinHash:
    """Keys of bands of min-wise hashes: two texts at similarity s share one of them with chance 1 - (1 - s^rows)^bands."""

    def __init__(self, bands: int, rows: int, seed: int = 20):
        self.bands, self.rows = bands, rows
        self.turn, self.scale = np.random.default_rng(seed).integers(1, 2**32, (2, bands * rows), dtype=np.uint32)
        self.scale |= np.uint32(1)

    def keys(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(texts with shingles, bands) keys as signed longs."""
        some = counts[counts > 0]
        if not len(some):
            return np.zeros((0, self.bands), np.int64)
        at, x = np.cumsum(some) - some, (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.zeros((len(some), self.bands), np.uint64)
        for b in range(self.bands):
            key = np.full(len(some), b + 1, np.uint64)
            for j in range(b * self.rows, (b + 1) * self.rows):
                key = mixed(key * _STEP + np.minimum.reduceat((x ^ self.turn[j]) * self.scale[j], at))
            out[:, b] = key
        return out.view(np.int64)
