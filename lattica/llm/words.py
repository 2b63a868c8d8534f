"""Words of many texts as 64-bit hashes, by array operations over their UTF-8 bytes.

A word's hash is a polynomial of its bytes modulo 2^64, taken from a running sum over the whole slice, then
mixed with its length. Hashes stand for words; where operators need more certainty they compare
long sequences of them, whose sums go through another mixing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .shared import packed_bytes

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_U = np.uint64

_bytes = np.arange(256)
#: A-Z to a-z; other bytes stay.
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Everything but a blank and the control characters from tab to carriage return.
UNSPACED = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: After lower-casing: digits, a-z and whatever is not ASCII.
ALPHANUMERIC = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)


class Words(NamedTuple):
    """All words of a slice: `hashes`, where each begins and ends in `data`, and the n + 1 offsets of the texts' words and bytes."""

    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """P^i and P^-i for i below n."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(texts: pa.Array, kind: np.ndarray, lower: bool) -> Words:
    """The words (runs of bytes of this kind) of each text; null has none."""
    data, bounds = packed_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    before[bounds[:-1]] = False  # a text's first byte follows nothing
    begins = np.flatnonzero(inside & ~before)
    after = np.zeros(n + 1, bool)
    after[:n] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return Words(hashes, begins, ends, np.searchsorted(begins, bounds).astype(np.int64), data, bounds)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of each run of `size` hashes, at the run's begin; len(hashes) - size + 1 of them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * _U(_P) + hashes[k : k + n]
    else:
        power, inverse = _tables(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
        total = (sums[size:] - sums[:-size]) * inverse[:n]
    return mix(total + _U(size * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


def inside_texts(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins of all runs of `size` words that lie in one text, and those begins' counts per text."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    total = int(counts.sum())
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts - offsets[:-1], counts), counts
