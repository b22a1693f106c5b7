"""Word and shingle hashes of whole texts, computed on the bytes of an Arrow batch.

Words are the longest runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A word's
hash is a polynomial in its bytes, taken from running sums, so no Python runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.arange(256, dtype=np.uint64)
_CODE[65:91] += U(32)
_CODE += U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of stretches of *column* of about CHUNK_BYTES, or of one
    longer text. A null is an empty text."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word, index of the first word of each text and the end)."""
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(size + 1, bool)  # a text begins here
    edge[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:size]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:size]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, back = _powers(BASE, size), _powers(INVERSE, size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_CODE[data] * power, out=sums[1:])
    hashes = (sums[end] - sums[start]) * back[start]
    return mix(hashes + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)), np.searchsorted(start, offsets)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; kept for the usual chunk size."""
    known = _POWERS.get(base)
    if known is None or len(known) < size:
        known = np.full(max(size, 2 * CHUNK_BYTES), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 2 * CHUNK_BYTES:
            _POWERS[base] = known
    return known[:size]


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its *words*-word shingles. A text with fewer words
    has its whole sequence as one shingle, one without words has none."""
    for _, data, offsets in texts(column):
        hashes, first = word_hashes(data, offsets)
        many = len(hashes) - words + 1
        rolled = hashes[:many].copy() if many > 0 else np.zeros(0, np.uint64)
        for i in range(1, words):
            if many > 0:
                rolled = mix(rolled * U(3) + hashes[i : i + many])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = hashes[a:b]
                h = whole[:1] * U(7)
                for i in range(1, b - a):
                    h = mix(h * U(3) + whole[i : i + 1])
                yield mix(h + U(b - a))
            else:
                yield np.zeros(0, np.uint64)
