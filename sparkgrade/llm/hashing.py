"""Words and word shingles of Arrow texts as 64-bit hashes, in numpy over the UTF-8 bytes.

A word's hash is a polynomial over random values of its bytes: a difference of prefix sums
times an inverse power, mixed. Nothing runs once per word in Python.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _values() -> np.ndarray:
    """A value for each byte; A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
    values[65:91] = values[97:123]
    return values


@functools.cache
def _inside(alnum: bool) -> np.ndarray:
    """Bytes that are in words: all but white space, or all but ASCII other than letters and digits."""
    b = np.arange(256)
    if alnum:
        return (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    return ~((b == 32) | ((b >= 9) & (b <= 13)))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)])) for base in (_R, _R_INVERSE)]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: pa.Array, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more at the end). Null: no words.

    Words are runs of anything but blank, tab, LF, VT, FF and CR, or, if alnum, of ASCII
    letters and digits and anything beyond ASCII. A-Z count as a-z.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    low, high = int(at[0]), int(at[-1])
    if low == high:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[low:high]
    at = at - low
    word = _inside(alnum)[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = at[:-1][at[:-1] < at[1:]]
    first[edges] = word[edges]
    last[edges[1:] - 1] = word[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    powers, inverse = _powers(len(raw))
    sums = np.cumsum(_values()[raw] * powers[: len(raw)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix((sums[ends] - before) * inverse[starts]), np.searchsorted(starts, at)


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, in order, and where each text's begin; fewer words are one shingle."""
    lengths = np.diff(bounds)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    out = np.concatenate([[0], np.cumsum(counts)])
    if not len(words):
        return np.zeros(0, np.uint64), out
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * _BASE + words[k : k + len(rolled)]
    full = lengths >= n
    texts = np.flatnonzero(full)
    where = np.repeat(bounds[:-1][texts] - (np.cumsum(counts[texts]) - counts[texts]), counts[texts]) + np.arange(int(counts[texts].sum()))
    got = np.zeros(int(out[-1]), np.uint64)
    got[np.repeat(out[:-1][texts] - (np.cumsum(counts[texts]) - counts[texts]), counts[texts]) + np.arange(len(where))] = rolled[where]
    for i in np.flatnonzero(~full & (lengths > 0)):
        h = np.uint64(lengths[i])
        with np.errstate(over="ignore"):
            for w in words[bounds[i] : bounds[i + 1]]:
                h = (h ^ w) * _M1 + _BASE
        got[out[i]] = h
    return mix(got), out
