"""Vectorised text kernels that run inside Spark tasks (numpy over Arrow buffers).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Those bytes never occur inside a
multi-byte UTF-8 sequence, so byte work gives the same words as work on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KIND = np.zeros(256, np.uint8)  # 1: ASCII letter, 2: ASCII mark other than an apostrophe
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[x for x in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_INV = U64(_inverse(int(_BASE)))
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BYTE_VALUE[_SPACE] = 0
_STEP = np.random.default_rng(7).integers(1, 1 << 63, 512, dtype=np.uint64) | U64(1)
_powers = {"pow": np.ones(1, U64), "inv": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers["pow"]) < n:
        size = max(n, 1 << 18)
        for name, x in (("pow", _BASE), ("inv", _INV)):
            a = np.full(size, x, U64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["pow"][:n], _powers["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Words:
    """Words of a run of documents: start, end (byte offsets), doc (index in the run), hash. With marks, a word is cut between an ASCII letter and a mark too."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True, marks: bool = False):
        self.data, self.offsets, n = data, offsets, len(data)
        self.n_docs = len(offsets) - 1
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
            self.first = np.zeros(self.n_docs + 1, np.int64)
            return
        space = _SPACE[data]
        word = ~space
        begin = word.copy()
        begin[1:] &= space[:-1]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begin[edge] = word[edge]
        if marks:
            kind = _KIND[data]
            begin[1:] |= (kind[1:] | kind[:-1]) == 3
        close = word.copy()
        close[:-1] &= space[1:]
        close[edge - 1] = word[edge - 1]
        if marks:
            close[:-1] |= begin[1:] & word[:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(close) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.hash = np.zeros(len(self.start), U64)
        if hashes and len(self.start):
            up, down = powers(n)
            value = _BYTE_VALUE[_LOWER[data] if lower else data]
            value *= up
            self.hash = mix(np.add.reduceat(value, self.start) * down[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i+k-1 for each i (length n-k+1, at least 0)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += word_hash[j : j + n] * _STEP[j]
    return mix(out)


def sequence_hash(word_hash: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words, with its length."""
    up, _ = powers(len(word_hash) + 1)
    total = np.sum(word_hash * up[: len(word_hash)], dtype=U64, keepdims=True)
    return mix(total + np.array([len(word_hash)], U64) * _STEP[-1])[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `most` bytes, one row at least: (from, to, bytes, offsets). A null is an empty text."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, len(texts))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of each row."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
