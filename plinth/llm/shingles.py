"""Hashes of word shingles over Arrow text buffers, in numpy.

A-Z are lower-cased and words are runs of bytes other than space and
\\t \\n \\v \\f \\r. A document with fewer words than a shingle has its whole
sequence as one shingle; without words it has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plinth.llm.common import chunks, text_bytes

_RNG = np.random.RandomState(20240229)
_CODE = _RNG.randint(1, 2**63 - 1, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_CODE = _CODE[_LOWER]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """An odd base's first n powers and their inverses modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        made = []
        for one in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, one, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[base] = (made[0], made[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and the words' offsets by row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = powers(n + 1)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.empty(n, bool)
    starts[0] = True
    starts[1:] = space[:-1]
    starts |= edge[:-1]
    starts &= ~space
    ends = np.empty(n, bool)
    ends[-1] = True
    ends[:-1] = space[1:]
    ends |= edge[1:]
    ends &= ~space
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    total = np.cumsum((_LOWER_CODE if lower else _CODE)[data] * up[:n])
    before = np.where(first > 0, total[first - 1], np.uint64(0))
    words = mix((total[last] - before) * down[first])
    return words, np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, by_row: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle, repeats included, and the shingles' offsets by row."""
    count = np.diff(by_row)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(made)))
    step = np.uint64(0xD6E8FEB86659FD93)
    rolled = words.copy()
    factor = step
    for j in range(1, min(width, len(words))):
        rolled[: len(words) - j] += words[j:] * factor
        factor = factor * step
    at = np.repeat(by_row[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    out = rolled[at] if len(at) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((count > 0) & (count < width)):
        value = 0
        for w in words[by_row[i] : by_row[i + 1]].tolist():
            value = (value * 0xD6E8FEB86659FD93 + w + 1) & 0xFFFFFFFFFFFFFFFF
        out[offsets[i]] = np.uint64(value ^ int(count[i]))
    return mix(out), offsets


def shingle_sets(column: pa.Array, width: int = 5):
    """The sorted distinct shingle hashes of each row, in row order."""
    data, offsets = text_bytes(column)
    old = np.seterr(over="ignore")
    try:
        for i, j in chunks(offsets):
            part = offsets[i : j + 1]
            words, by_row = word_hashes(data[part[0] : part[-1]], part - part[0])
            hashes, at = shingle_hashes(words, by_row, width)
            for k in range(j - i):
                yield np.unique(hashes[at[k] : at[k + 1]])
    finally:
        np.seterr(**old)
