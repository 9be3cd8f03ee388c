"""Words of whole texts as 64-bit hashes, by numpy over the bytes of an Arrow slice.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash is a polynomial
in a fixed odd base over random byte values, taken from prefix sums, then mixed; two different words agree
with probability near 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply, twice)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for i, base in enumerate((_ODD, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end)."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """``first[i]:first[i + 1]`` are the words of row i; starts and ends are byte places in ``data``."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(texts: pa.StringArray, fold: np.ndarray = _LOWER, letters: np.ndarray = _WORD) -> Words:
    """Words of every row of a string array without nulls; ``fold`` maps bytes, ``letters`` marks word bytes."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = fold[np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]] if raw is not None else fold[:0]
    offsets = offsets - offsets[0]
    inside = letters[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = inside[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(data, offsets, starts, ends, span_hashes(data, starts, ends),
                 np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_ODD) + words[j:len(words) - k + 1 + j] + np.uint64(1))
    return out


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run [start, end) of word hashes, in order."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[np.minimum(starts, len(down) - 1)] + (ends - starts).astype(np.uint64))
