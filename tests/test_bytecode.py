"""Kernel expressions against a plain sweep over bytes."""

import random

import pytest
from pyspark.sql import functions as F

from coderill.functions import bytecode as B
from coderill.operators import codes, ingest

SLOT = B.IMPLEMENTATION_SLOT


def sweep(code: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(code):
        size = code[at] - 0x5F if 0x60 <= code[at] <= 0x7F else 0
        out.append(code[at : at + 1 + size])
        at += 1 + size
    return out


def stripped(code: bytes) -> bytes:
    n = int.from_bytes(code[-2:], "big") if len(code) >= 2 else 0
    at = len(code) - 2 - n
    return code[:at] if n and at >= 0 and 0xA1 <= code[at] <= 0xA5 else code


CODES = [b"", b"\x60", bytes.fromhex("600161ff"), bytes.fromhex("feff7f"), bytes.fromhex("60ff"), bytes.fromhex("ff"), bytes.fromhex("6000" * 5)]
CODES += [random.Random(k).randbytes(k) for k in range(1, 80)]
CODES += [bytes.fromhex("6001") + bytes.fromhex("a165627a7a72305820") + bytes(32) + bytes.fromhex("0029")]


@pytest.fixture(scope="module")
def kernel(spark):
    hx = F.col("hx")
    frame = spark.createDataFrame([(c.hex(),) for c in CODES], "hx string")
    rows = frame.select("hx", B.body(hx).alias("body"), B.tokens(B.body(hx)).alias("tok")).select("hx", "body", "tok", B.skeleton(F.col("tok")).alias("skeleton"), B.selectors(F.col("tok")).alias("selectors"), B.shingles(B.numbered(B.opcodes(F.col("tok")))).alias("runs"))
    return {r.hx: r for r in rows.collect()}


def test_instructions_and_bodies(kernel):
    for code in CODES:
        assert kernel[code.hex()].body == stripped(code).hex()
        assert kernel[code.hex()].tok == [t.hex() for t in sweep(stripped(code))]


def test_skeletons_zero_wide_pushes(kernel):
    for code in CODES:
        want = b"".join(t[:1] + bytes(len(t) - 1) if t[0] in (0x73, 0x7F) else t for t in sweep(stripped(code)))
        assert kernel[code.hex()].skeleton == want.hex()


def test_shingles(kernel):
    for code in CODES:
        ops = [t[:1].hex() for t in sweep(stripped(code))]
        assert set(kernel[code.hex()].runs) == {int("".join(ops[i : i + 5]), 16) for i in range(len(ops) - 4)}


def test_selectors_need_a_comparison(spark):
    hx = "63aabbccdd14" + "63000000018014" + "6311111111808014" + "6322222222" + "63aabbccdd14" + "63ffff"
    got = spark.createDataFrame([(hx,)], "hx string").select(B.selectors(B.tokens(F.col("hx"))).alias("s")).first().s
    assert got == ["0x00000001", "0x22222222", "0xaabbccdd"]


def test_proxies_and_slots(spark):
    clone = B.CLONE_HEAD + "ab" * 20 + B.CLONE_TAIL
    rows = spark.createDataFrame([(clone,), (clone + "00",), ("ef0100" + "cd" * 20,), ("7f" + SLOT,), ("60" + "7f" + SLOT,)], "hx string")
    got = rows.select(B.proxy_kind(F.col("hx")).alias("k"), B.proxy_target(F.col("hx")).alias("t"), B.is_standard_proxy(B.tokens(B.body(F.col("hx")))).alias("s")).collect()
    assert [(r.k, r.t, r.s) for r in got] == [("eip1167", "0x" + "ab" * 20, False), (None, None, False), ("eip7702", "0x" + "cd" * 20, False), (None, None, True), (None, None, False)]
    words = ["0x" + "0" * 24 + "AB" * 20, "0x" + "0" * 64, "0x" + "0" * 23 + "1" + "ab" * 20, "0x1", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(B.slot_address(F.col("w")).alias("a")).collect()
    assert [r.a for r in got] == ["0x" + "ab" * 20, None, None, None, None]


def test_candidates_tolerate_odd_receipts(spark):
    rows = [(1, '{"contractAddress":"0xAA","to":null,"logs":[{"address":"0xBB"},{}]}'), (1, "[]"), (1, None), (1, "nonsense"), (1, '{"to":"0xaa"}'), (2, '{"to":"0xaa"}')]
    frame = spark.createDataFrame(rows, "block long, receipt string")
    got = {(r.block, r.address): r.origin for r in ingest.candidates(ingest.touched(frame)).collect()}
    assert got == {(1, "0xaa"): "created", (1, "0xbb"): "seen", (2, "0xaa"): "seen"}


def test_first_record_of_an_address_stays(spark):
    rows = [("0xA", "", 2, "created", None), ("0xa", "00", 1, "seen", None)]
    got = codes.addresses(spark.createDataFrame(rows, "address string, hx string, block long, origin string, implementation string")).collect()
    assert [(r.address, r.block, r.origin) for r in got] == [("0xa", 1, "seen")]


def test_beacon_counts_only_after_a_read_slot(spark):
    word = lambda a: "0x" + "0" * 24 + a * 20
    slots = [("p", "implementation", word("aa")), ("q", "implementation", "0x" + "0" * 64), ("q", "beacon", word("bb")), ("r", "implementation", None), ("r", "beacon", word("cc"))]
    frame = spark.createDataFrame(slots, "address string, slot string, word string")
    got = ingest.resolved(spark.createDataFrame([("p",), ("q",), ("r",)], "address string"), frame).collect()
    assert {r.address: r.implementation for r in got} == {"p": "0x" + "aa" * 20, "q": "0x" + "bb" * 20, "r": None}
