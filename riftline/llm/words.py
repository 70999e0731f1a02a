"""Word and shingle hashes of many texts at once, on the bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
Its hash is a polynomial over its bytes modulo 2^64, taken as a difference of
running sums and put through a 64-bit finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes hashed in one go: bounds memory at some tens of times this.
CHUNK = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _pow:
        _pow.clear()
        _pow[size] = _powers(_ODD, size), _powers(_INVERSE, size)
    up, down = _pow[size]
    return up[:n], down[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so distinct sums stay distinct."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def pieces(column: pa.Array):
    """Runs of rows whose bytes come to CHUNK, or single longer rows: (first row, bytes, offsets)."""
    data, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """(words per text, hash of each word, then its hash up to each of ``prefixes`` bytes)."""
    n = len(data)
    if not n:
        return (np.zeros(len(offsets) - 1, np.int64), *[np.zeros(0, np.uint64)] * (1 + len(prefixes)))
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    starts = inside[1:-1] & ~inside[:-2]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    starts[cuts] |= inside[1:-1][cuts]
    ends = inside[1:-1] & ~inside[2:]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    out = [mix64((sums[b] - sums[a]) * down[a])]
    for k in prefixes:
        out.append(mix64((sums[np.minimum(b, a + k)] - sums[a]) * down[a] + np.uint64(k)))
    return (np.searchsorted(a, offsets[1:]) - np.searchsorted(a, offsets[:-1]), *out)


def shingle_sets(column: pa.Array, width: int):
    """For runs of rows: (first row, sizes, hashes) - the distinct shingles of each text, sorted, one after another."""
    for first, data, offsets in pieces(column):
        counts, h = word_hashes(data, offsets)
        rows = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        s = np.zeros(len(h), np.uint64)
        # A shingle is hashed from its words in order; one cut short by the end of its text is dropped below.
        for k in range(width):
            shifted = h[k:] if k == 0 else np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])
            s = mix64(s * np.uint64(_ODD) + shifted + np.uint64(k + 1))
        place = np.arange(len(h)) - (ends - counts)[rows] if len(h) else np.zeros(0, np.int64)
        keep = place + width <= counts[rows]
        for r in np.flatnonzero((counts > 0) & (counts < width)):
            begin, whole = ends[r] - counts[r], np.uint64(counts[r])
            for x in h[begin : ends[r]]:
                whole = mix64(np.array([(int(whole) * _ODD + int(x)) & (2**64 - 1)], np.uint64))[0]
            s[begin], keep[begin] = whole, True
        s, rows = s[keep], rows[keep]
        borders = np.searchsorted(rows, np.arange(len(counts) + 1))
        for r in np.flatnonzero(np.diff(borders) > 1):
            s[borders[r] : borders[r + 1]].sort()
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (rows[1:] != rows[:-1])
        s, rows = s[fresh], rows[fresh]
        yield first, np.bincount(rows, minlength=len(counts)), s
