"""Vectorised word splitting and hashing over a slice of many documents.

Words are runs of bytes other than space and 0x09-0x0D; a document boundary
always ends a word.  A word's key is a 64-bit multilinear hash of its bytes
(random odd coefficient per position) passed through a finaliser; two
different words of a corpus with V words share a key with probability of
about V^2 / 2^65.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_SPAN = 1 << 12
#: Bytes of text whose words are hashed at a time.
_SLICE = 1 << 21
_COEFF = np.random.Generator(np.random.PCG64(20240607)).integers(
    0, 1 << 63, size=_SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """An order-dependent 64-bit key of several key arrays."""
    out = np.zeros_like(parts[0])
    for i, p in enumerate(parts):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + p + np.uint64(i + 1))
    return out


@dataclass
class Words:
    """Words of a slice: ``doc`` is the row of each word, ``first`` the index of
    each row's first word (length rows + 1), ``inside`` marks the bytes of words."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    inside: np.ndarray


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a document starts here
    begins = inside & edge[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & edge[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, np.flatnonzero(ends) + 1, doc, first, inside)


def keys(data: np.ndarray, words: Words) -> np.ndarray:
    """The 64-bit key of each word, ``_SLICE`` bytes of text at a time."""
    if len(words.start) == 0:
        return np.zeros(0, np.uint64)
    out, first = np.empty(len(words.start), np.uint64), 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(words.end, words.start[first] + _SLICE, "right")))
        span = slice(int(words.start[first]), int(words.end[last - 1]))
        out[first:last] = _keys(data[span], words.inside[span], (words.end - words.start)[first:last])
        first = last
    return out


def _keys(data: np.ndarray, inside: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = np.cumsum(length) - length  # start of each word among the word bytes
    byte = data[inside].astype(np.uint64)
    byte += np.uint64(1)
    within = np.arange(len(byte), dtype=np.int64)
    within -= np.repeat(at, length)
    if int(length.max()) > _SPAN:
        byte *= (within // _SPAN).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        within &= _SPAN - 1
    byte *= _COEFF[within]
    return mix64(np.add.reduceat(byte, at) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def counted(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(mark, offsets[some], dtype=np.int64)
    return out


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's range, empty rows 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64),
                            np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
