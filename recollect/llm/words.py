"""Words and shingles of whole Arrow string columns as numpy arrays of 64-bit fingerprints.

Words are the maximal runs without space and \\x09-\\x0D, A-Z lower-cased, read straight from the UTF-8 bytes. A word's
fingerprint is a polynomial hash by prefix sums, mixed; two different words or shingles share one with a
probability of about 2^-64. Documents go through in blocks of a few MB, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  #: bytes of text handled at once; a longer text makes a block of its own
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed * 2 + 1)) | np.uint64(1)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, BLOCK + 1)
        for name, p in (("_powers", _P), ("_inverse", pow(_P, -1, 1 << 64))):
            x = np.full(n, p, dtype=np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _powers, _inverse


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of stretches of the column; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and len(column) else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, start byte, end byte of each word; words before each text)."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[True], space])
    after = np.concatenate([space, [True]])
    starts = np.flatnonzero(~after[:-1] & (before[:-1] | edge[:-1]))
    ends = np.flatnonzero(~before[1:] & (after[1:] | edge[1:])) + 1
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct fingerprints of its shingles; with fewer words the whole sequence is one."""
    multipliers = odd_multipliers(size, 77)
    for _, data, offsets in blocks(column):
        hashes, _, _, first = words(data, offsets)
        rolled = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
        for j in range(size):
            rolled += hashes[j : j + len(rolled)] * multipliers[j]
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                yield mix((hashes[a:b] * multipliers[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield rolled[:0]
