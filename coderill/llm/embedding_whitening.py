"""Whitening of embeddings by an exact integer scatter.

An entry c becomes the integer x = floor(64 c) + 1,000,000. A shift, the integer that stands for c = 0, is subtracted again
before anything is summed: covariances do not depend on it, and sums stay small. Each batch gives the exact sums S and
cross-products of its shifted integers: they are split into limbs so short that a product of matrices in doubles is
exact, and joined again as integers of any length. Batches are added in Spark, in limbs of 31 bits that cannot overflow,
and n X'X - SS' is made of integers. Only then do numbers become doubles: the covariance is decomposed by ``eigh``, and
rotations in the platform's long doubles follow, so that small components of large matrices keep their digits.

A second pass reads the vectors and gives each its deviation and its components, and the sums for the covariance of
what it gives. What meets at the driver are matrices of dimensions by dimensions, whatever the number of rows.

Vectors that are null or empty, hold null or non-finite entries, or are not of the table's most frequent length (of several
the greatest) are dropped; those of another length lack entries. Entries beyond 2^55 in size count as 2^55. Rows
count and return as often as they come; null ids stay null. Of components that do not vary, as all do of one vector, ``whitened`` is null,
and they are not in ``identity_error``; ``explained`` is null where nothing varies, and ``identity_error`` then too. Where a
deviation is beyond a long it is null; ``deviation_text`` has all digits. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.llm.worker import tidy

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
_BOUND = 1 << 55
_ROWS = 4096
_LIMB = 20  # bits: 4,096 products of two limbs are below 2^53
_CARRY = 31


def integers(entries: np.ndarray) -> np.ndarray:
    """x - SHIFT of each entry, in 64 bits."""
    return np.floor(np.clip(entries.astype(np.float64), -_BOUND, _BOUND) * SCALE).astype(np.int64)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2^20 more than the one before, is ``x``; all below 2^19 in size, but for the last."""
    out = []
    while True:
        low = ((x + (1 << (_LIMB - 1))) & ((1 << _LIMB) - 1)) - (1 << (_LIMB - 1))
        rest = (x - low) >> _LIMB
        out.append(low.astype(np.float64))
        if not rest.any():
            return out
        x = rest


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of rows of 64-bit integers, as Python integers."""
    d = x.shape[1]
    sums, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
    for lo in range(0, len(x), _ROWS):
        parts = limbs(x[lo : lo + _ROWS])
        for i, a in enumerate(parts):
            sums += a.sum(axis=0).astype(np.int64).astype(object) << (_LIMB * i)
            for j, b in enumerate(parts):
                products += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return sums, products


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vec"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


LIMBS = "cell int, limb int, value long"


def _cells(values: list[int]) -> pa.RecordBatch:
    """Integers as limbs of 31 bits; the sign is in the value of the limbs."""
    rows = []
    for cell, v in enumerate(values):
        sign, v, k = (1 if v >= 0 else -1), abs(int(v)), 0
        while v:
            rows.append((cell, k, sign * (v & ((1 << _CARRY) - 1))))
            v, k = v >> _CARRY, k + 1
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["cell", "limb", "value"])


def _joined(rows: list, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=object)
    for r in rows:
        out[r["cell"]] += int(r["value"]) << (_CARRY * r["limb"])
    return out


class Fit(NamedTuple):
    """Row count, sums of x - SHIFT, eigenvalues and eigenvectors (columns) by falling eigenvalue, and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _rotated(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jacobi's rotations in long doubles on a basis that is nearly right."""
    q = q.astype(np.longdouble)
    for _ in range(2):  # the basis made orthonormal beyond a double's digits
        q = q @ (1.5 * np.eye(len(q), dtype=np.longdouble) - 0.5 * (q.T @ q))
    a = q.T @ v @ q
    eps = np.finfo(np.longdouble).eps
    for _ in range(12):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                x = a[i, j]
                if abs(x) <= 4 * eps * np.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                turned = True
                t = (a[j, j] - a[i, i]) / (2 * x)
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(1 + t * t))
                c = 1 / np.sqrt(1 + t * t)
                turn = np.array([[c, c * t], [-c * t, c]], dtype=np.longdouble)
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j], :] = turn.T @ a[[i, j], :]
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    return np.diagonal(a).copy(), q


def decompose(n: int, sums: np.ndarray, products: np.ndarray) -> Fit:
    """Eigenvalues and unit eigenvectors of the covariance that exact sums and cross-products have, with divisor n."""
    exact = n * products - np.multiply.outer(sums, sums)
    square = n * n
    # the nearest double of each entry and of what it leaves, which together are a long double
    high = np.array([[int(x) / square for x in row] for row in exact])
    ratio = [[float(h).as_integer_ratio() for h in row] for row in high]
    low = np.array([[(int(x) * q - p * square) / (square * q) for x, (p, q) in zip(row, ratios)] for row, ratios in zip(exact, ratio)])
    v = high.astype(np.longdouble) + low
    _, start = np.linalg.eigh(high)
    values, vectors = _rotated(v, start)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    trace = int(np.trace(exact)) / square
    floor = float(values[0]) * len(values) * float(np.finfo(np.longdouble).eps) * 16
    values = np.where(values > floor, values, 0)
    return Fit(n, sums, values.astype(np.float64), vectors.astype(np.float64), trace)


def fit(vectors: DataFrame, dims: int) -> Fit:
    """Of (vec array<double>), all of ``dims`` finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            x = integers(_vectors(batch, dims))
            s, p = scatter(x)
            n, sums, products = n + len(x), sums + s, products + p
        if n:
            yield _cells([n, *sums, *products[np.triu_indices(dims)]])

    rows = vectors.mapInArrow(tidy(run), LIMBS).groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect()  # dims^2 / 2 integers
    upper = np.triu_indices(dims)
    whole = _joined(rows, 1 + dims + len(upper[0]))
    products = np.zeros((dims, dims), dtype=object)
    products[upper] = whole[1 + dims :]
    products.T[upper] = whole[1 + dims :]
    return decompose(int(whole[0]), whole[1 : 1 + dims], products)


def _whitened(x: np.ndarray, model: Fit, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact n x - S of each row, in 64 bits where they fit, and its components; nan for those that do not vary."""
    most = int(np.abs(x).max(initial=0)) * model.n + max(abs(int(s)) for s in model.sums)
    x = x if most < 1 << 62 else x.astype(object)
    centred = x * model.n - (model.sums.astype(np.int64) if most < 1 << 62 else model.sums)
    e = model.values[:components]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (centred.astype(np.float64) / model.n) @ (model.vectors[:, :components]) / np.sqrt(e)
    out[:, e <= 0] = np.nan
    return centred, out


def _squares(centred: np.ndarray) -> list[int]:
    """Exact sums of squares of each row."""
    if centred.dtype == object or int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] >= 1 << 62:
        centred = centred.astype(object)
    return [int(s) for s in (centred * centred).sum(axis=1)]


def identity_error(vectors: DataFrame, dims: int, model: Fit, components: int) -> float | None:
    """Largest absolute entry of the covariance of what ``_whitened`` gives, less the identity."""
    live = int((model.values[:components] > 0).sum())
    if not live:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _whitened(integers(_vectors(batch, dims)), model, components)[1][:, :live]
            mean = w.mean(axis=0)
            within = (w - mean).T @ (w - mean) + len(w) * np.multiply.outer(mean, mean)
            values = np.concatenate([w.sum(axis=0), within.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"])

    rows = vectors.mapInArrow(tidy(run), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # components^2 numbers
    total = np.zeros(live + live * live)
    for r in rows:
        total[r["cell"]] = r["value"]
    mean = total[:live] / model.n
    covariance = total[live:].reshape(live, live) / model.n - np.multiply.outer(mean, mean)
    return float(np.abs(covariance - np.eye(live)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_text) for each remaining row and component."""
    vec = F.col(vector_col).cast("array<double>")
    plain = table.select(F.col(id_col).alias("vec_id"), vec.alias("vec"))
    kind = plain.schema[0].dataType.simpleString()
    whole = plain.filter(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("vec") > 0))
    sizes = whole.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    schema = f"vec_id {kind}, n long, deviation long, deviation_text string, whitened array<double>"
    if common is None:
        empty = table.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")
        return empty.withColumnRenamed("vec_id", id_col)
    dims = common["d"]
    whole = whole.filter(F.size("vec") == dims)
    model = fit(whole.select("vec"), dims)
    components = min(components, dims)
    error = identity_error(whole.select("vec"), dims, model, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred, w = _whitened(integers(_vectors(batch, dims)), model, components)
            squares = _squares(centred)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * components), flat)
            long = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.n] * len(w), pa.int64()), long, pa.array([str(s) for s in squares]), lists], names=["vec_id", "n", "deviation", "deviation_text", "whitened"])

    rows = whole.mapInArrow(tidy(run), schema)
    explained = F.array(*(F.lit(float(e) / model.trace if model.trace else None).cast("double") for e in model.values[:components]))
    out = rows.select("vec_id", "n", "deviation", "deviation_text", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        F.col("vec_id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_text",
    )
