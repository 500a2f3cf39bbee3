"""SQL functions against the column expressions on random and edge codes."""

import random

import pytest
from pyspark.sql import functions as F

from coderill.functions import bytecode as B
from coderill.functions import sql
from coderill.functions.similarity import code_similarity, jaccard
from coderill.operators.similarity import similarity_of


@pytest.fixture(scope="module")
def codes(spark):
    sql.register(spark)
    draw = random.Random(5)
    parts = ["63aabbccdd14", "6311223344" + "8114", "7f" + B.IMPLEMENTATION_SLOT, "73" + "12" * 20, "54", "f4", "ff", "00", "60", "7f12", "a165627a0003", "63aabb"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randrange(9))) for _ in range(150)]
    made += [B.CLONE_HEAD + "ab" * 20 + B.CLONE_TAIL, B.DELEGATION_HEAD + "cd" * 20, "", "00", "0000", "a10001", "a20001", "00a1650002", "ffff", "a1" + "00" * 3 + "0004", "a60001"]
    frame = spark.createDataFrame([(h,) for h in made] + [(None,)], "hx string").coalesce(2)
    frame.createOrReplaceTempView("sample_codes")
    return frame


def test_kernel(spark, codes):
    hx = F.col("hx")
    split = codes.withColumn("tok", B.tokens(B.body(hx)))
    ops = B.opcodes(F.col("tok"))
    kind, standard = B.proxy_kind(hx), B.is_standard_proxy(F.col("tok"))
    want = split.select(
        "hx", B.body(hx).alias("body"), B.trailer(hx).alias("trailer"), "tok", ops.alias("ops"), B.selectors(F.col("tok")).alias("selectors"), kind.alias("kind"), B.proxy_target(hx).alias("target"), standard.alias("std"),
        B.skeleton(F.col("tok")).alias("skeleton"), B.selfdestructs(ops).alias("sd"), B.mutable_delegatecall(ops, kind, standard).alias("md"), F.size(B.shingles(B.numbered(ops))).alias("n5"), F.size(B.shingles(B.numbered(ops), 3)).alias("n3"),
    )
    got = spark.sql("""
      SELECT hx, evm_body(hx) AS body, evm_trailer(hx) AS trailer, tok, evm_opcodes(tok) AS ops, evm_selectors(tok) AS selectors, evm_proxy_kind(hx) AS kind, evm_proxy_target(hx) AS target, evm_std_proxy(tok) AS std,
        evm_skeleton(tok) AS skeleton, evm_selfdestruct(tok) AS sd, evm_mutable_delegatecall(hx, tok) AS md, size(evm_shingles(tok, 5)) AS n5, size(evm_shingles(tok, 3)) AS n3
      FROM (SELECT hx, evm_tokens(evm_body(hx)) AS tok FROM sample_codes)""")
    key = lambda r: repr(r["hx"])
    rows = lambda f: sorted((r.asDict() for r in f.filter("hx IS NOT NULL").collect()), key=key)
    assert rows(got) == rows(want)
    null = got.filter("hx IS NULL").drop("n5", "n3").first()
    assert all(v is None for name, v in null.asDict().items() if name not in ("skeleton",))


def test_scores(spark, codes):
    near = spark.sql("SELECT x.hx AS x, y.hx AS y FROM sample_codes x JOIN sample_codes y ON length(x.hx) % 4 = length(y.hx) % 4")
    near.createOrReplaceTempView("sample_pairs")
    # columns of each way in one row
    both = near.withColumn("want", similarity_of(F.col("x"), F.col("y"))).withColumn("got", F.expr("evm_similarity(x, y)"))
    assert both.filter("NOT want <=> got").count() == 0 and both.filter("got > 0 AND got < 1").count() > 0
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), ([], []), (["a"], ["a"])], "x array<string>, y array<string>")
    rows = sets.select(jaccard(F.col("x"), F.col("y")), F.expr("evm_jaccard(x, y)"), code_similarity(F.col("x"), F.col("y")), F.expr("evm_code_similarity(x, y)")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows)


def test_checks(spark, codes):
    words = ["0x" + "0" * 24 + "Ab" * 20, "0X" + "0" * 64, "0x" + "0" * 23 + "1" + "a" * 40, "", None, "0x", "0xzz", "0x" + "a" * 40, "0xabc"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    rows = frame.select(B.slot_address(w), F.expr("evm_slot_address(w)"), B.is_hex_code(w), F.expr("evm_is_code(w)"), B.is_address(w), F.expr("evm_is_address(w)")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in rows)


def test_flags(spark, codes):
    pairs = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "a boolean, b boolean")
    rows = pairs.select(B.flags(F.col("a"), F.col("b")), F.expr("evm_flags(a, b)")).collect()
    assert len({r[0] for r in rows}) == 4 and all(r[0] == r[1] for r in rows)


def test_nothing_runs_in_python(spark, codes):
    plan = spark.sql("SELECT evm_fingerprint(hx) AS f FROM sample_codes")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "evm_" not in plan
