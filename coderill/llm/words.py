"""Vectorised word kernel shared by the n-gram operators.

Words are maximal runs of bytes other than space and U+0009..U+000D, so a whole Arrow batch is split
and hashed with a few NumPy passes over its UTF-8 bytes. No pass copies more than ``BLOCK`` bytes of
text at once, except for a single word that is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RAW = np.arange(256, dtype=np.uint8)
_LOWER = _RAW.copy()
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = _U(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    """Words of documents ``lo`` to ``hi`` of a batch: a count for each document, then flat arrays."""

    lo: int
    hi: int
    counts: np.ndarray  # int64, a document each
    hashes: np.ndarray  # uint64, a word each
    starts: np.ndarray  # int64 byte offset of the word in its own document
    ends: np.ndarray

    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
        done += step
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, BLOCK + 4096)
        tables = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
        if size > 4 * BLOCK:
            return tables
        _tables["up"], _tables["down"] = tables
    return _tables["up"], _tables["down"]


def _hash_block(data: np.ndarray, firsts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in ``data``; no word crosses an offset in ``firsts``."""
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = firsts[(firsts > 0) & (firsts < n)]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[edge - 1] = inside[edge - 1]
    ends = np.flatnonzero(finish) + 1
    up, down = _power_tables(n + 1)
    sums = ((_LOWER if lower else _RAW)[data].astype(np.uint64) + _U(1)) * up[:n]
    np.cumsum(sums, out=sums)
    total = sums[ends - 1]
    before = starts > 0
    total[before] -= sums[starts[before] - 1]
    return starts, ends, mix(total * down[starts] + (ends - starts).astype(np.uint64) * _GRAM)


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def split_words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[Words]:
    """Words of every text of a string column, null as empty, in slices of about ``BLOCK`` bytes."""
    texts = as_strings(column)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, side="right")) - 1)
        hi = min(hi, n)
        if hi == lo + 1 and offsets[hi] - offsets[lo] > BLOCK:
            yield _long_text(lo, data[offsets[lo] : offsets[hi]], lower)
        else:
            base = offsets[lo : hi + 1] - offsets[lo]
            starts, ends, hashes = _hash_block(data[offsets[lo] : offsets[hi]], base[:-1], lower)
            cuts = np.searchsorted(starts, base)
            counts = np.diff(cuts)
            shift = np.repeat(base[:-1], counts)
            yield Words(lo, hi, counts, hashes, starts - shift, ends - shift)
        lo = hi


def _long_text(lo: int, data: np.ndarray, lower: bool) -> Words:
    parts, at = [], 0
    none = np.zeros(0, dtype=np.int64)
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while to < len(data):  # a block ends before white space, so that no word is cut
            gap = np.flatnonzero(_SPACE[data[to : to + BLOCK]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + BLOCK, len(data))
        starts, ends, hashes = _hash_block(data[at:to], none, lower)
        parts.append((starts + at, ends + at, hashes))
        at = to
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    return Words(lo, lo + 1, np.array([len(starts)]), hashes, starts, ends)


def grams(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether they all lie in its document."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= _GRAM
        out[: max(0, n - j)] += hashes[j:]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    return mix(out + _U(k)), left >= k


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none holds much over ``size`` bytes of ``text``, save for one long row."""
    for batch in batches:
        column = as_strings(batch.column(batch.schema.get_field_index(text)))
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
