"""Word-shingle and MinHash kernels (numpy only, no Spark).

Words are maximal runs of bytes other than space and 0x09-0x0D, after
lower-casing A-Z.  A shingle is ``width`` consecutive words; a text with fewer
words has one shingle made of all of them, a text without words has none.
Shingles are 64-bit hashes: two different shingles of a corpus of 10^9 distinct
ones collide with probability below 3 %, so set sizes are exact in practice.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multiplier of the byte polynomial and of the word polynomial.
_BYTE_P = 0x9E3779B97F4A7C15
_WORD_P = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_INV = pow(_BYTE_P, -1, 1 << 64)

#: Byte -> lower-cased byte plus one, 0 for white space.
_TABLE = np.arange(1, 257, dtype=np.uint64)
_TABLE[65:91] += _U(32)
_TABLE[[9, 10, 11, 12, 13, 32]] = 0

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's 64-bit hash, start and end, in order, and the text's bytes."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), raw
    code = _TABLE[raw]
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.not_equal(code, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(code * _power_table(_BYTE_P, len(raw)), out=total[1:])
    return mix((total[end] - total[start]) * _power_table(_INV, len(raw))[start]), start, end, raw


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order."""
    return word_spans(text)[0]


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < width:
        width = len(w)
    out = np.zeros(len(w) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * _U(_WORD_P) + w[k : len(w) - width + 1 + k]
    return np.unique(mix(out + _U(width)))


def permutations(n: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2)


def minhashes(sets: list[np.ndarray], n: int = 128, seed: int = 17, room: int = 1 << 18) -> np.ndarray:
    """A row of ``n`` MinHash values (uint64) for each non-empty set."""
    a, b = permutations(n, seed)
    out = np.empty((len(sets), n), dtype=np.uint64)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (last == first or held + len(sets[last]) <= room):
            held += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        at = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        for i in range(n):
            out[first:last, i] = np.minimum.reduceat(x * a[i] + b[i], at)
        first = last
    return mix(out)
