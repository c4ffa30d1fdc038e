"""Array hashing used inside tasks: range hashes of symbol sequences in O(1) per range.

``prefix`` builds a prefix sum of ``symbol * BASE**i`` (mod 2**64); ``ranges`` turns any
[start, stop) into one mixed 64-bit value that depends only on the range's symbols.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step; a bijection on 64-bit values."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: One 64-bit symbol per byte value.
BYTES = mix((np.arange(1, 257, dtype=np.uint64)) * BASE)
#: The separators of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        seq = np.full(size, base, dtype=np.uint64)
        seq[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(seq)
    return have[:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * _powers(BASE, len(symbols)), out=out[1:])
    return out


def ranges(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    inv = _powers(BASE_INV, len(p))
    return mix((p[stop] - p[start]) * inv[start] + (stop - start).astype(np.uint64))


def fixed(p: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` symbols, by start."""
    n = len(p) - k
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix((p[k:] - p[:n]) * _powers(BASE_INV, n) + U(k))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and stops of the words of concatenated texts, and the word offset of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    first[full] |= ink[full]
    ends = full[1:] - 1  # the byte before each following text closes a word
    last[ends] |= ink[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return ranges(prefix(BYTES[data]), starts, stops)
