"""Corpus-wide counts of 64-bit keys for chunks of documents, by request and answer.

Rows are dealt to chunks by their place in the input, whatever their ids or texts, so chunks are of one size. Each
chunk asks for its distinct keys once, with its own counts: the request goes to the bucket of the keys'
leading bits, where the totals are made, and the answer returns as counts in the order of
the request. A key that half of all rows hold is still one entry for each chunk, so no bucket is hot.

A request is a row for each chunk and bucket. Chunks and buckets are of 16 MB of text, and of more from 64 GB on, growing with the
square root of the input (``tables.shards``: 64 MB at 1 TB, 640 MB at 100 TB), so that a row has some 4 KB and the
number of rows grows in proportion to the input.

Keys travel whole, in rising order, as their differences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def chunk_of(chunks: int) -> Column:
    """The chunk of a row by its file and place there, which are the same whenever they are read."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts by byte plane, compressed: the planes of small counts are zero."""
    wide = np.uint32 if not len(counts) or int(counts.max()) < 1 << 32 else np.uint64
    planes = counts.astype(wide).view(np.uint8).reshape(len(counts), -1).T.tobytes()
    return bytes([wide().itemsize]) + pa.compress(planes, codec="lz4", asbytes=True)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    planes = np.frombuffer(pa.decompress(data[1:], data[0] * n, codec="lz4", asbytes=True), dtype=np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(np.uint32 if len(planes) == 4 else np.uint64).ravel().astype(np.int64)


def _pack_keys(keys: np.ndarray, codec: str = "lz4") -> bytes:
    """Keys in rising order; the upper bytes of their differences are zero, and compressed."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(len(keys), 8).T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(planes, codec=codec, asbytes=True)


def _unpack_keys(data: bytes, codec: str = "lz4") -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec=codec, asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Where buckets by leading bits begin and end in rising keys; ``buckets`` is a power of two."""
    edges = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1))) if buckets > 1 else []
    return [0, *map(int, edges), len(keys)]


REQUEST = "bucket int, chunk int, keys binary, counts binary"
ANSWER = "chunk int, bucket int, counts binary, n_keys long, n_counted long"


def requests(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int, base: int = 0) -> pa.Table:
    """Rows of REQUEST for a chunk's keys, distinct and in rising order; ``buckets`` is a power of two.

    Keys of another kind use buckets from another ``base`` on.
    """
    at = cuts(keys, buckets)
    spans = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]
    return pa.table(
        {
            "bucket": pa.array([base + b for b, _, _ in spans], pa.int32()),
            "chunk": pa.array([chunk] * len(spans), pa.int32()),
            "keys": pa.array([_pack_keys(keys[lo:hi]) for _, lo, hi in spans], pa.binary()),
            "counts": pa.array([pack_counts(counts[lo:hi]) for _, lo, hi in spans], pa.binary()),
        }
    )


def _answer(table: pa.Table) -> pa.Table:
    keys = [_unpack_keys(x) for x in table["keys"].to_pylist()]
    counts = [unpack_counts(x, len(k)) for x, k in zip(table["counts"].to_pylist(), keys)]
    distinct = np.unique(np.concatenate(keys))
    total = np.zeros(len(distinct), dtype=np.int64)
    places = [np.searchsorted(distinct, k) for k in keys]
    for at, n in zip(places, counts):
        total[at] += n  # a chunk's keys are distinct
    return pa.table(
        {
            "chunk": table["chunk"],
            "bucket": table["bucket"],
            "counts": pa.array([pack_counts(total[at]) for at in places], pa.binary()),
            "n_keys": [int((total > 0).sum())] + [0] * (len(keys) - 1),
            "n_counted": [int(total.sum())] + [0] * (len(keys) - 1),
        }
    )


def totals(asked: DataFrame) -> DataFrame:
    """Rows of ANSWER for rows of REQUEST.

    ``n_keys`` and ``n_counted`` stand on one row of each bucket: its keys with a count, and their sum.
    """
    return asked.groupBy("bucket").applyInArrow(_answer, ANSWER)


def answered(table: pa.Table, keys: np.ndarray, buckets: int, base: int = 0) -> np.ndarray:
    """Totals in the order of the chunk's ``keys``, from its rows of ANSWER."""
    at = cuts(keys, buckets)
    out = np.zeros(len(keys), dtype=np.int64)
    for b, data in zip(table["bucket"].to_pylist(), table["counts"].to_pylist()):
        b -= base
        if 0 <= b < buckets:
            out[at[b] : at[b + 1]] = unpack_counts(data, at[b + 1] - at[b])
    return out


def with_answers(docs: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(documents of a chunk, its answers)`` for each chunk."""
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
