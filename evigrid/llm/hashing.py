"""Vectorised hashing of words over whole Arrow batches (numpy, no loop over words)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once.
CHUNK = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Byte tables: A-Z to a-z, and what separates words (ASCII white space).
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of each text; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word: bytes that are not blank, within one text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~blank[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= ~solid[:-1] | ~solid[1:]
    return np.flatnonzero(solid & cut[:-1]), np.flatnonzero(solid & cut[1:]) + 1


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each of the spans, which follow each other. Memory is that of CHUNK bytes, however long a span is.

    The hash is a polynomial, so the part of a span in one chunk is shifted by a power of the base to where it belongs.
    """
    total = np.zeros(len(begin), np.uint64)
    for a in range(0, len(data), CHUNK):
        b = min(a + CHUNK, len(data))
        i, j = np.searchsorted(end, a, "right"), np.searchsorted(begin, b, "left")
        if i >= j:
            continue
        code = (TO_LOWER[data[a:b]] if lower else data[a:b]).astype(np.uint64)
        code += np.uint64(1)
        code *= _table("base", _BASE, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(code, out=sums[1:])
        low, high = np.maximum(begin[i:j], a) - a, np.minimum(end[i:j], b) - a
        part = (sums[high] - sums[low]) * _table("inverse", _INVERSE, b - a)[low]
        if begin[i] < a:
            part[:1] *= np.uint64(pow(int(_BASE), int(a - begin[i]), 1 << 64))
        total[i:j] += part
    return mix(total + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each text the position of its first word (one more entry at the end)."""
    begin, end = word_spans(data, offsets)
    return hash_spans(data, begin, end, lower), np.searchsorted(begin, offsets, "left")
