"""Vectorised tokens of Arrow text: word spans, 64-bit word hashes and hashes of word n-grams.

All arithmetic is modulo 2**64 on numpy arrays. A word's hash sums random per-byte values times powers of an odd base,
so equal words hash alike wherever they stand and different ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]


def powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hash of each span of ``values`` (uint64 per symbol)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(BASE_INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row each belongs to; words never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, most: int = 1 << 20):
    """(word hashes, row of each word, starts, ends). Long rows are hashed in parts cut between words."""
    starts, ends, rows = word_spans(data, offsets)
    values = LOWER_VALUES if lower else BYTE_VALUES
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        lo, hi = starts[at], ends[upto - 1]
        hashes[at:upto] = span_hashes(values[data[lo:hi]], starts[at:upto] - lo, ends[at:upto] - lo)
        at = upto
    return hashes, rows, starts, ends


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows + 1 positions at which each row's words begin."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, ignoring rows; len(words) - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(n, np.uint64), 0
    block, have, base = words, 1, GRAM_BASE  # polynomials of 1, 2, 4, ... words and the base to that power
    while True:
        if k & have:
            out = out * base + block[done : done + n]
            done += have
        if have * 2 > k:
            return mix(out)
        block, have, base = block[:-have] * base + block[have:], have * 2, np.uint64(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, row of each). A row with fewer than k words but at least one gives its whole sequence."""
    grams = ngram_hashes(words, k)
    whole = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, bool)
    bounds = row_bounds(rows, n_rows)
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < k))
    short = np.zeros(len(few), np.uint64)
    for j in range(k - 1):
        have = np.diff(bounds)[few] > j
        short[have] = short[have] * GRAM_BASE + words[bounds[few[have]] + j]
    short = mix(short + np.diff(bounds)[few].astype(np.uint64))
    return np.concatenate([grams[whole], short]), np.concatenate([rows[: len(grams)][whole], few])


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, rows ascending."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[first], rows[first]
