"""Cosine near-duplicates of vectors by an epsilon grid order join.

Unit vectors with a cosine of at least ``threshold`` lie within ``epsilon = sqrt(2 - 2 threshold)``. They
are projected on leading principal dimensions (an orthonormal basis, fitted on a bounded sample, so that
distances only shrink) and sorted by the grid cells of side ``epsilon`` in these dimensions. The sorted
sequence is cut into intervals of at most ``INTERVAL`` vectors, which carry the box of their coordinates.
Intervals meet where their boxes cover cells that are neighbours in several leading dimensions (more of them, the more
intervals there are) and are within ``epsilon``; a pair of
intervals is joined by halving both, leaving out halves whose boxes are provably distant, down to blocks
whose cosines are computed in double precision. Results do not depend on the basis or the cuts.
Vectors travel as they came, in single precision where that is what they have, and are made unit vectors where they meet.

Equal vectors are one class that is joined once, with its size as weight. A task returns link counts and
a spanning forest of its links, not the links, so dense groups stay linear in rows.

Null vectors, those of length zero, and those with null, NaN or infinite components link with nothing,
nor do vectors of different dimensions. Repeated rows link with one another like any equal vectors and
give rows of their own; a null id gets its links and a component like the others, null if it stands
alone. Extra columns are dropped, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.llm.graph import Forest, components
from coderill.llm.tables import materialise

THRESHOLD = 0.95
INTERVAL = 4096
LEADING = 12
#: Vectors that the principal dimensions are fitted on, at most: those of the lowest id hashes.
SAMPLE = 20_000
_LEAF = 256


def _usable(v: Column) -> Column:
    x = v.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda c: c != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, scaled first so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def principal(sample: np.ndarray, leading: int) -> np.ndarray:
    """An orthonormal basis (dimensions, leading) of the directions of greatest variance."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :leading]
    _, vectors = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))
    return np.ascontiguousarray(vectors[:, ::-1][:, :leading])


class Sequence:
    """Unit vectors in epsilon grid order, with the boxes of its halves, their halves, and so on."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray):
        self.vectors, self.places = vectors, vectors @ basis
        self._boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self._boxes:
            part = self.places[lo:hi]
            self._boxes[lo, hi] = part.min(axis=0), part.max(axis=0)
        return self._boxes[lo, hi]


def links(a: Sequence, b: Sequence, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``a``, in ``b``) of all linked pairs; within one sequence, each pair once."""
    reach = 2 - 2 * threshold + 1e-9
    same = a is b
    stack = [(0, len(a.vectors), 0, len(b.vectors))]
    while stack:
        i, j, k, m = stack.pop()
        if i == j or k == m or (same and k < i):
            continue
        (low, high), (other_low, other_high) = a.box(i, j), b.box(k, m)
        gap = np.maximum(0, np.maximum(low - other_high, other_low - high))
        if gap @ gap > reach:
            continue  # provably distant
        if j - i <= _LEAF and m - k <= _LEAF:
            x, y = np.nonzero(a.vectors[i:j] @ b.vectors[k:m].T >= threshold)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
            continue
        halves = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > _LEAF else [(i, j)]
        others = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > _LEAF else [(k, m)]
        stack += [(*h, *o) for h in halves for o in others]


def _cells(places: np.ndarray, epsilon: float) -> np.ndarray:
    return np.floor(places / epsilon).astype(np.int64)


def _placed(vectors: DataFrame, basis: np.ndarray, epsilon: float) -> DataFrame:
    """Vectors with their grid cells as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                cells = _cells(unit(flat) @ basis, epsilon)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["class", "v", "weight", "cells"])

    return vectors.select("class", "v", "weight").mapInArrow(run, "class long, v array<double>, weight long, cells array<long>")


INTERVALS = "interval long, low array<double>, high array<double>, classes binary, weights binary, vectors binary"


def _intervals(placed: DataFrame, basis: np.ndarray, size: int) -> DataFrame:
    """Runs of the sorted sequence, one row each; a task holds one run at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table, number: int) -> pa.RecordBatch:
            table = table.combine_chunks()
            flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            vectors = unit(flat)
            places = vectors @ basis
            with np.errstate(over="ignore"):
                single = flat.astype(np.float32)
            return pa.RecordBatch.from_pydict(
                {
                    "interval": [number], "low": [places.min(axis=0).tolist()], "high": [places.max(axis=0).tolist()], "classes": [table["class"].to_numpy().tobytes()],
                    "weights": [table["weight"].to_numpy().tobytes()], "vectors": [(single if (single == flat).all() else flat).tobytes()],
                },
                schema=pa.schema([("interval", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("classes", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary())]),
            )

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield emit(table.slice(0, size), number)
                number += 1
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield emit(pa.Table.from_batches(held), number)

    return placed.mapInArrow(run, INTERVALS)


FOUND = "class long, n long, root long"


def _join_pair(one: dict, other: dict, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def opened(x: dict) -> tuple[np.ndarray, np.ndarray, Sequence]:
        classes, data = np.frombuffer(x["classes"], np.int64), x["vectors"]
        kind = np.float64 if len(data) == 8 * len(classes) * len(basis) else np.float32
        return classes, np.frombuffer(x["weights"], np.int64), Sequence(unit(np.frombuffer(data, kind).astype(np.float64).reshape(len(classes), -1)), basis)

    a = opened(one)
    b = a if one["interval"] == other["interval"] else opened(other)
    shift = 0 if a is b else len(a[0])
    classes, weights = (a[0], a[1]) if a is b else (np.concatenate((a[k], b[k])) for k in (0, 1))
    n, forest = np.zeros(len(classes), dtype=np.int64), Forest(len(classes))
    roots = np.arange(len(classes))
    for x, y in links(a[2], b[2], threshold):
        y = y + shift
        np.add.at(n, x, weights[y])
        np.add.at(n, y, weights[x])
        ties = np.unique(roots[x] * len(classes) + roots[y])  # one for each two components
        one_side, other_side = ties // len(classes), ties % len(classes)
        if (one_side != other_side).any():
            for i, j in zip(one_side.tolist(), other_side.tolist()):
                forest.join(i, j)
            touched = np.unique(np.concatenate((one_side, other_side)))
            moved = np.arange(len(classes))
            moved[touched] = [forest.find(i) for i in touched.tolist()]
            roots = moved[roots]
    some = np.flatnonzero(n)
    return classes[some], n[some], classes[roots[some]]


def _linked(vectors: DataFrame, dimensions: int, threshold: float, size: int) -> DataFrame:
    """FOUND rows of classes (class, v, weight) of one dimension."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) or 1e-6
    rows = vectors.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("v").collect()
    basis = principal(unit(np.array([r["v"] for r in rows], dtype=np.float64)), min(LEADING, dimensions))
    # equal cells are parted by a hash, so that a crowded cell is no single task
    order = [F.col("cells")[k] for k in range(min(4, dimensions))] + [F.xxhash64("class")]
    spread = _placed(vectors, basis, epsilon).repartitionByRange(*order).sortWithinPartitions("cells", "class")
    spread = spread.coalesce(max(1, -(-vectors.count() // size)))  # ranges beside one another, so that intervals are full
    intervals = materialise(_intervals(spread, basis, size))
    # each interval stands under the cells that its box covers in some dimensions, and meets those of a higher number that cover
    # neighbouring cells
    boxes = intervals.select("interval", "low", "high")
    n = boxes.count()
    used = min(len(basis[0]), max(1, round(math.log(max(n, 2), 7))), 3)
    cells = lambda place: F.floor(place / F.lit(epsilon)).cast("long")
    under = near = boxes
    for k in range(used):
        under = under.withColumn(f"c{k}", F.explode(F.sequence(cells(F.col("low")[k]), cells(F.col("high")[k]))))
        near = near.withColumn(f"c{k}", F.explode(F.sequence(cells(F.col("low")[k]) - 1, cells(F.col("high")[k]) + 1)))
    near = near.select(*(F.col(c).alias(f"o_{c}") for c in ("interval", "low", "high")), *(f"c{k}" for k in range(used)))
    gaps = F.zip_with(F.zip_with("low", "o_high", lambda a, b: a - b), F.zip_with("o_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    met = under.join(near, [f"c{k}" for k in range(used)]).filter((F.col("interval") <= F.col("o_interval")) & (apart <= 2 - 2 * threshold + 1e-9))
    pairs = met.select("interval", "o_interval").distinct()
    held = ("classes", "weights", "vectors")
    left = intervals.select("interval", *held)
    right = intervals.select(F.col("interval").alias("o_interval"), *(F.col(c).alias(f"o_{c}") for c in held))
    dealt = pairs.join(left, "interval").join(right, "o_interval")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found = _join_pair(row, {c: row[f"o_{c}"] for c in ("interval", *held)}, basis, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["class", "n", "root"])

    return dealt.select("interval", "o_interval", *held, *(f"o_{c}" for c in held)).mapInArrow(run, FOUND)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, interval: int = INTERVAL
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``."""
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"))
    usable = plain.filter(_usable(F.col("raw"))).select("id", F.col("raw").cast("array<double>").alias("v"))
    # a class is numbered by a hash of its vector, which stands for it from here on
    members = materialise(usable.select("id", "v", F.xxhash64(F.size("v"), "v").alias("class")))
    classes = members.groupBy("class").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    classes = materialise(classes)
    found = None
    for row in classes.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        part = _linked(classes.filter(F.size("v") == row["d"]), row["d"], threshold, interval)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = plain.sparkSession.createDataFrame([], FOUND)
    found = materialise(found)
    tied = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    joined = classes.select("class", "weight", "least").join(counts, "class", "left").join(tied, "class", "left").withColumn("component", F.coalesce("component", "class"))
    leasts = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = joined.join(leasts, "component").select("class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = members.select("id", "class").join(joined, "class").select("id", "n_links", "component_id")
    alone = plain.filter(~_usable(F.col("raw"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
