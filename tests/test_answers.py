"""Shapes of JSON answers: a plain walk over parsed JSON, and typed values."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from coderill.functions.answers import SHAPES, checked


def walk(x, shape, path="$"):
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    if isinstance(shape, str):
        ok = number if shape.startswith("number") else isinstance(x, str)
        return None if ok or (shape.endswith("?") and x is None) else path
    if isinstance(shape, tuple):
        return None if isinstance(x, str) and x in shape else path
    if isinstance(shape, list):
        if not isinstance(x, list):
            return path
        return next((f for f in (walk(e, shape[0], f"{path}[{i}]") for i, e in enumerate(x)) if f), None)
    if not isinstance(x, dict):
        return path
    return next((f for f in (walk(x[k], s, f"{path}.{k}") if k in x else f"{path}.{k}" for k, s in shape.items()) if f), None)


def good(shape, draw):
    if isinstance(shape, str):
        if shape.endswith("?") and draw.random() < 0.3:
            return None
        return draw.choice([0, -3, 2.5, 10**20, 7]) if shape.startswith("number") else draw.choice(["", "x", 'q"\\\n', "é"])
    if isinstance(shape, tuple):
        return draw.choice(shape)
    if isinstance(shape, list):
        return [good(shape[0], draw) for _ in range(draw.randrange(4))]
    return {"more": [1]} | {k: good(s, draw) for k, s in shape.items()}


def spoilt(x, draw):
    """One value somewhere replaced or left out."""
    x = copy.deepcopy(x)
    at = x
    while True:
        keys = list(at) if isinstance(at, dict) else list(range(len(at)))
        key = draw.choice(keys)
        if isinstance(at[key], (dict, list)) and at[key] and draw.random() < 0.7:
            at = at[key]
            continue
        if isinstance(at, dict) and draw.random() < 0.3:
            del at[key]
        else:
            at[key] = draw.choice([None, "x", 1, True, [], {}, [None], {"a": 1}])
        return x


@pytest.mark.parametrize("name", SHAPES)
def test_faults_and_values(spark, name):
    draw, shape = random.Random(name), SHAPES[name]
    answers = [good(shape, draw) for _ in range(60)]
    answers += [spoilt(a, draw) for a in answers] + [None, 1, "x", [], {}]
    want = [(json.dumps(a), walk(a, shape)) for a in answers] + [(t, "$") for t in ("", "{", '{"a":1,}', "nothing", None)]
    rows = spark.createDataFrame(want, "answer string, want string").withColumn("c", checked(F.col("answer"), shape)).select("answer", "want", "c.*").collect()
    assert len(rows) == len(want)
    assert [r for r in rows if r["fault"] != r["want"]] == []
    assert any(r["fault"] is None for r in rows) and any((r["fault"] or "").count(".") for r in rows)
    for r in rows:
        assert (r["value"] is None) == (r["fault"] is not None)
        if r["value"] is not None:
            held = json.loads(r["answer"])
            for key, value in r["value"].asDict(recursive=True).items():
                assert _without_more(held[key]) == value


def _without_more(x):
    if isinstance(x, dict):
        return {k: _without_more(v) for k, v in x.items() if k != "more"}
    return [_without_more(v) for v in x] if isinstance(x, list) else x
