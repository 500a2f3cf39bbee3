"""Shapes of words: what is known of a word that a vocabulary does not have."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from coderill.llm import words

_U = np.uint64

_CLASS = np.zeros(256, dtype=np.uint8)  # bits: upper 1, lower or beyond ASCII 2, digit 4, comma-like 8, other sign 16
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 4
for _c in b".,;:'-":
    _CLASS[_c] = 8
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 16


def _kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = np.bitwise_or.reduceat(_CLASS[data], starts) if len(starts) else np.zeros(0, np.uint8)
    # reduceat runs on to the next word's start; white space between has no class
    last = _CLASS[data[ends - 1]] if len(ends) else kinds
    return kinds, last, np.minimum((ends - starts) // 6, 4)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small hash for what kinds of characters a word has, whether it begins upper, and how long it is."""
    kinds, last, size = _kinds(data, starts, ends)
    return words.mix(kinds.astype(np.uint64) | last.astype(np.uint64) << _U(8) | size.astype(np.uint64) << _U(16) | _U(1 << 40))


#: Numbers of shapes are below this.
SHAPES = 1 << 13


def shape_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same as a number, another one for each shape."""
    kinds, last, size = _kinds(data, starts, ends)
    return kinds.astype(np.int64) | last.astype(np.int64) << 5 | size.astype(np.int64) << 10


def hashed(texts: pa.ChunkedArray | pa.Array, shape: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = shapes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: first row, words of each, word hashes with case, and shapes."""
    column = words.as_strings(texts)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    for w in words.split_words(column, lower=False):
        base = np.repeat(offsets[w.lo : w.hi], w.counts)
        lo = int(offsets[w.lo])
        part = raw[lo : int(offsets[w.hi])]
        yield w.lo, w.counts, w.hashes, shape(part, w.starts + base - lo, w.ends + base - lo)
