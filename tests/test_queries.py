"""Registered queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from coderill import queries
from coderill.operators import calibration

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in found), key=repr)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    assert rows(frame.columns, frame.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_grid_and_labels(tmp_path):
    assert calibration.parse_grid("0.5, 1,0.5") == [0.5, 1.0, 0.5]
    with pytest.raises(ValueError):
        calibration.parse_grid("0.5,x")
    path = tmp_path / "labels.json"
    path.write_text('{"positives": [["0x' + "A" * 40 + '", "0x' + "b" * 40 + '"]], "other": 1}')
    assert calibration.load_labels(str(path)) == {"strict": [], "positives": [["0x" + "a" * 40, "0x" + "b" * 40]], "negatives": []}
    path.write_text('{"positives": [["x", "y"]]}')
    with pytest.raises(ValueError):
        calibration.load_labels(str(path))
