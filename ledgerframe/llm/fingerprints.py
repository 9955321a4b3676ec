"""Word and n-gram fingerprints of whole texts, computed on the bytes of an Arrow column with numpy.

A fingerprint is a 64-bit polynomial over random byte values, finished by an avalanche step. Two different
words (or n-grams) of a corpus of n different ones share one with a chance of about n / 2**64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_M = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(x + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible avalanche step on uint64 (a new array)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE = _splitmix(256, 17)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_VALUE = _BYTE[_LOW]  # upper-case A-Z count as lower-case
_POW: np.ndarray = np.cumprod(np.full(1 << 12, 0x9FB21C651E98DF25, np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INV = np.uint64(pow(int(_STEP), -1, 1 << 64))

#: Bytes that separate words: white space alone, or all ASCII that is neither letter nor digit.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[:128] = [not chr(i).isalnum() for i in range(128)]


@dataclass
class Words:
    """All words of some texts in order. ``first[d]:first[d + 1]`` are those of text ``d``; start and end are byte offsets in ``data``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def text_bytes(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, and where each text begins and the last ends; null is empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if not len(column) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    n = int(offsets[-1] - offsets[0])
    data = np.frombuffer(buffers[2], np.uint8, n, int(offsets[0])) if n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, separators: np.ndarray = SPACE, fold: bool = True) -> Words:
    """Splits every text at ``separators`` and takes each word's fingerprint, with A-Z lower-cased if ``fold``."""
    global _POW
    data, offsets = bytes_of(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data, offsets)
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # a text's end also ends a word
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, first, data, offsets)
    longest = int((end - start).max())
    if longest > len(_POW):
        _POW = np.cumprod(np.full(2 * longest, _POW[0], np.uint64))
    spans = np.diff(np.append(start, n))
    at = np.arange(start[0], n, dtype=np.int32)
    at -= np.repeat(start.astype(np.int32), spans)
    value = np.take(_VALUE if fold else _BYTE, data[start[0] :])
    value *= np.take(_POW, at, mode="clip")
    value *= inside[start[0] :]  # separators behind a word count as zero
    hashed = mix(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64))
    return Words(hashed, start, end, first, data, offsets)


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the k items from each position on; len(hashes) - k + 1 of them, whatever texts they cross."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if k <= 16:
            total = hashes[k - 1 :].copy()
            for j in range(k - 2, -1, -1):
                total *= _STEP
                total += hashes[j : j + n]
            return mix(total)
        power = np.full(len(hashes), _STEP, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        back = np.full(n, _STEP_INV, np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power, out=sums[1:])
        return mix((sums[k:] - sums[:n]) * back)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which of all positions of ``ngrams`` lie within one text."""
    ok = np.ones(max(0, int(first[-1]) - k + 1), bool)
    if k > 1:
        for b in first[1:-1]:
            ok[max(0, b - k + 1) : b] = False
    return ok
