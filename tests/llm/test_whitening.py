"""op12 against exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from coderill.llm import embedding_whitening, queries

SCHEMA = "vec_id long, embedding array<double>, n long, vec string"


def integer(c):
    return math.floor(Fraction(c) * 64) + 1_000_000


def check(got, rows, components=32):
    """Rows of the operator against the definition on the vectors that remain."""
    x = [[integer(c) for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    cov = [[Fraction(sum(r[i] * r[j] for r in x) * n - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    trace = float(sum(cov[k][k] for k in range(d)))
    values = np.linalg.eigvalsh(np.array(cov, dtype=float))[::-1]
    components = min(components, d)
    assert len(got) == n * components and {r.component for r in got} == set(range(1, components + 1))
    assert all(r.n == n for r in got)
    want = sorted((str(k), sum((n * a - s) ** 2 for a, s in zip(v, sums))) for (k, _), v in zip(rows, x))
    assert sorted((str(r.vec_id), int(r.deviation_text)) for r in got if r.component == 1) == want
    assert all(r.deviation == (int(r.deviation_text) if int(r.deviation_text) < 1 << 63 else None) for r in got)
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-4, abs=1e-15) if trace else r.explained is None
    return np.array(cov, dtype=float), values


def test_limbs_are_exact():
    rng = np.random.default_rng(2)
    for most in (3, 1 << 19, 1 << 40, 1 << 61):
        x = rng.integers(-most, most, (embedding_whitening._ROWS + 50, 3))
        sums, products = embedding_whitening.scatter(x)
        wide = x.astype(object)
        assert (sums == wide.sum(axis=0)).all() and (products == wide.T.dot(wide)).all()


@pytest.mark.parametrize("offset,scale", [(0, 1), (1e9, 1), (-3e4, 1e6)])
def test_whitened(spark, offset, scale):
    """Also far from zero, where doubles would lose the variance."""
    rng = random.Random(4)
    mix = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(6)]
    rows = []
    for k in range(300):
        g = [rng.gauss(0, 1) for _ in range(6)]
        rows.append((k, [offset + scale * sum(a * b for a, b in zip(m, g)) for m in mix]))
    frame = spark.createDataFrame([(k, v, 5, "x") for k, v in rows], SCHEMA).repartition(4)
    got = embedding_whitening.whiten(frame, components=4).collect()
    check(got, rows, 4)
    w = np.zeros((300, 4))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    error = np.abs(np.cov(w.T, bias=True) - np.eye(4)).max()
    assert error < 1e-9 and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs(w.mean(axis=0)).max() < 1e-9


def test_dropped_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -1.25, 3.0]), (1, [0.5, -1.25, 3.0]), (None, [2.0, 2.0, 0.01]), (4, [-0.001, 7.5, 1.0]), (5, [1e6, 0.0, -3.0])]
    bad = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 2.0]), (10, [inf, 1.0, 2.0]), (11, [1.0, -inf, 0.0]), (12, [1.0]), (13, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame([(k, v, 5, "x") for k, v in good + bad], SCHEMA)
    check(embedding_whitening.whiten(frame).collect(), good)


def test_what_does_not_vary(spark):
    frame = spark.createDataFrame([(1, [0.5, 2.0], 5, "x")], SCHEMA)
    got = embedding_whitening.whiten(frame).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0], 5, "x") for k in range(9)], SCHEMA)
    got = embedding_whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-9
    assert embedding_whitening.whiten(frame.limit(0)).collect() == []
    assert embedding_whitening.whiten(frame.limit(0)).columns == embedding_whitening.whiten(line).columns


def test_deviation_beyond_a_long(spark):
    rows = [(k, [1e9 * k, -2e9 * k]) for k in range(5)]
    got = embedding_whitening.whiten(spark.createDataFrame([(k, v, 5, "x") for k, v in rows], SCHEMA)).collect()
    check(got, rows)
    assert any(r.deviation is None for r in got)


def test_long_vectors(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(130)]) for k in range(150)]
    got = embedding_whitening.whiten(spark.createDataFrame([(k, v, 5, "x") for k, v in rows], SCHEMA)).collect()
    check(got, rows)
    assert got[0].identity_error < 1e-9


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r.vec_id, list(r.embedding)) for r in table]
    got = queries.QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    cov, values = check(got, rows)
    assert got[0].identity_error < 1e-4
    # the projections have the covariance of the components
    x = np.array([[integer(c) for c in v] for _, v in rows], dtype=float)
    at = {k: i for i, (k, _) in enumerate(rows)}
    w = np.zeros((len(rows), 32))
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
    axes = (x - x.mean(axis=0)).T @ w / len(rows) / np.sqrt(values[:32])  # each component up to its sign
    assert np.abs(cov @ axes - axes * values[:32]).max() < 1e-6 * values[0]
