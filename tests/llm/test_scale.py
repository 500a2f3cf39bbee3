"""Request and answer, crowded groups, and joins of intervals: sizes, exactness, odd inputs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coderill.llm import embedding_dedup, exchange, shingle_join, tables


def test_keys_travel_whole():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert (exchange._unpack_keys(exchange._pack_keys(keys)) == keys).all()
        assert len(exchange._pack_keys(keys)) < 9 * len(keys) + 200
    edge = np.array([0, 1, 1 << 63, (1 << 64) - 1], dtype=np.uint64)
    assert (exchange._unpack_keys(exchange._pack_keys(edge)) == edge).all()


@pytest.mark.parametrize("buckets", [1, 8, 64])
def test_answers_are_totals(buckets):
    rng = np.random.default_rng(2)
    chunks = [np.unique(rng.integers(0, 400, size=150).astype(np.uint64) << np.uint64(55)) for _ in range(5)]
    counts = [rng.integers(0, 4, size=len(k)) for k in chunks]
    asked = pa.concat_tables([exchange.requests(i, k, c, buckets) for i, (k, c) in enumerate(zip(chunks, counts))])
    answers = pa.concat_tables([exchange._answer(asked.filter(pa.compute.equal(asked["bucket"], b))) for b in set(asked["bucket"].to_pylist())])
    want = {}
    for k, c in zip(chunks, counts):
        for x, n in zip(k.tolist(), c.tolist()):
            want[x] = want.get(x, 0) + n
    for i, k in enumerate(chunks):
        mine = answers.filter(pa.compute.equal(answers["chunk"], i))
        assert exchange.answered(mine, k, buckets).tolist() == [want[x] for x in k.tolist()]
    assert sum(answers["n_counted"].to_pylist()) == sum(want.values()) and sum(answers["n_keys"].to_pylist()) == sum(n > 0 for n in want.values())


def test_messages_grow_with_the_input():
    """Rows of requests are shards squared; with some 4 KB each they stay in proportion to the input."""
    rows = {}
    for total in (1 << 30, 1 << 34, 1 << 40, 1 << 44, 1 << 47):
        each, n = max(16 << 20, int((4096 * total) ** 0.5)), 8
        while n * each < total:
            n *= 2
        rows[total] = n * n
        assert rows[total] <= 4 * total / 4096 + 64 * 64
    assert rows[1 << 47] / rows[1 << 40] <= 4 * (1 << 7)


def test_rows_of_one_id_are_dealt_to_all_chunks(spark):
    frame = spark.createDataFrame([(None, "a b")] * 4000, "doc_id long, text string").repartition(4)
    per = [r["count"] for r in frame.withColumn("chunk", exchange.chunk_of(8)).groupBy("chunk").count().collect()]
    assert len(per) == 8 and max(per) < 2 * 500


def test_crowded_groups_are_joined_alike(spark, monkeypatch):
    monkeypatch.setattr(tables, "CROWDED", 10)
    rows = spark.range(500).select((F.col("id") % F.when(F.col("id") < 300, 1).otherwise(50)).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    want = sorted(map(tuple, rows.join(groups, "k").select("k", "id", "least").collect()))
    assert sorted(map(tuple, tables.join_groups(rows, groups, ["k"], "n").select("k", "id", "least").collect())) == want
    monkeypatch.setattr(tables, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, tables.join_groups(rows, groups, ["k"], "n").select("k", "id", "least").collect())) == want


def test_shingle_join_of_copies_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tables, "CROWDED", 5)
    text, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(k, text) for k in range(40)] + [(100, other)] * 12 + [(101, other), (None, text), (None, text), (7, None), (200, "x " * 300_000)]
    frame = spark.createDataFrame([(k, t, 1, "f", 2) for k, t in rows], "doc_id long, text string, n int, f string, component long")
    got = shingle_join.join(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)
    assert len(found) == len(rows)
    assert {c for k, _, c in found if k is not None and k < 100} == {0} and {c for k, _, c in found if k in (100, 101)} == {100}
    assert [(n, c) for k, n, c in found if k is None] == [(26, None)] * 2 and (200, 1, 200) in found


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_of_many_intervals(spark, kind):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    rows = [(k, [float(np.float32(x)) if kind == "float" else float(x) for x in centres[k % 60] + 0.12 * rng.normal(size=16)]) for k in range(900)]
    frame = spark.createDataFrame([(k, v, 1, True) for k, v in rows], f"vec_id long, embedding array<{kind}>, class int, kept boolean")
    got = embedding_dedup.near_duplicates(frame, interval=8)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    label = np.arange(len(rows))
    for _ in range(60):
        label = np.array([label[near[i]].min() for i in range(len(rows))])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == {k: (int(near[k].sum()) - 1, int(label[k]), label[k] == k) for k, _ in rows}


def test_embeddings_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, []), (5, [0.0, 1.0]), (6, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(None, 3, 3, True)] * 2 + [(3, 3, 3, True)] * 2 + [(4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)], key=repr)
