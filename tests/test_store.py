"""The store, followed receipts in any order, caps, budgets, failures halfway, proxies, and the views over them."""

import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from coderill.functions.bytecode import BEACON_SLOT, IMPLEMENTATION_SLOT
from coderill.operators import ingest
from coderill.serving import respond
from coderill.sources import rpc
from coderill.sources.store import SCHEMAS, Store
from coderill.streaming.follow import Limits, backfill, drain, follow, ingest_batch, listen

CODE = "6080604052" + "".join(f"8063{i:08x}146100ff57" for i in range(8))
PROXY = f"60806040527f{IMPLEMENTATION_SLOT}54f4"


def receipt(*to, created=None):
    return json.dumps({"contractAddress": created, "to": to[0] if to else None, "logs": [{"address": t} for t in to[1:]]})


def answers(rows):
    """Codes by the last character of an address: a and b contracts, p a proxy, e an account, f no code."""
    last = F.right("address", F.lit(1))
    answer = F.when(last == "a", F.lit("0x" + CODE)).when(last == "b", F.lit("0x" + CODE + "00")).when(last == "p", F.lit("0x" + PROXY)).when(last == "e", F.lit("0x")).when(last == "f", F.lit("oops"))
    return rows.withColumn("answer", answer)


def batch_of(spark, *blocks):
    return spark.createDataFrame([(b, r) for b, rs in blocks for r in rs] or [], "block long, receipt string")


def stored(store):
    return {r.address: (r.code_id is not None, r.origin, r.block) for r in store.known().collect()}


@pytest.mark.parametrize("seed", range(3))
def test_follow_and_serve(spark, tmp_path, seed):
    receipts = tmp_path / "receipts"
    receipts.mkdir()
    blocks = {1: ["0xA"], 2: ["0xb", "0xe", "0xf"], 3: ["0xa", "0xb"]}
    store = Store(spark, str(tmp_path / "store"))

    def write(some):
        for block in some:
            rows = [json.dumps({"block": block, "receipt": json.dumps({"contractAddress": blocks[block][0], "to": t})}) for t in blocks[block]]
            (receipts / f"{block}.json").write_text("\n".join(rows))
            at = random.Random(10 * seed + block).randrange(1_000_000)
            os.utime(receipts / f"{block}.json", (at, at))  # files come in any order

    write([1])
    follow(spark, store, str(receipts), str(tmp_path / "checkpoint"), answers).awaitTermination()
    store.add_seed("0xA", "bad")
    write([3, 2])
    follow(spark, store, str(receipts), str(tmp_path / "checkpoint"), answers).awaitTermination()
    assert stored(store) == {"0xa": (True, "created", 1), "0xb": (True, "created", 2), "0xe": (False, "seen", 2)}
    events = respond(store, "/api/events?limit=5")[1]["events"]
    assert [(e["kind"], e["address"], e["seed_address"], e["score"]) for e in events] == [("ALERT", "0xb", "0xa", 1.0)]
    status, summary = respond(store, "/api/summary")
    assert status == 200 and summary["addresses"] == 3 and summary["codes"] == 2 and summary["seeds"] == 1 and summary["origins"]["created"] == 2
    assert respond(store, "/api/health")[1]["progress"] == 3
    assert respond(store, "/api/clusters?level=L0")[1]["clusters"] == []
    assert respond(store, "/api/clusters")[0] == respond(store, "/api/events?limit=0")[0] == 400 and respond(store, "/x")[0] == 404
    assert store.set_strict("0xa", True) and store.seeds().first().strict and store.strict_seeds().count() == 1
    store.add_seed("0xa", "renamed")
    assert [(r.label, r.strict) for r in store.seeds().collect()] == [("renamed", True)]
    assert store.remove_seed("0xA") and not store.remove_seed("0xa") and store.seeds().count() == 0


def test_a_cap_loses_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    limits = Limits(cap=1, prices={"eth_getCode": 80}, day="2026-01-01")
    out = ingest_batch(store, batch_of(spark, (1, [receipt("0x1a", "0x2a", "0x3b")])), answers, limits)
    assert (out.stopped, out.progress, out.pending) == ("cap", 0, 2)
    out = ingest_batch(store, batch_of(spark, (2, [receipt("0x4e")])), answers, limits)
    assert (out.stopped, out.progress, out.pending) == ("cap", 0, 1)
    assert drain(store, answers, limits).progress == 2 and store.pending().count() == 0
    assert stored(store) == {"0x1a": (True, "seen", 1), "0x2a": (True, "seen", 1), "0x3b": (True, "seen", 1), "0x4e": (False, "seen", 2)}
    assert store.spent("2026-01-01") == 4 * 80


def test_a_budget_stops_and_goes_on(spark, tmp_path):
    store, days = Store(spark, str(tmp_path / "store")), iter(["d1", "d1", "d2", "d3"])
    limits = Limits(budget=170, prices={"eth_getCode": 80}, day=lambda: next(days))
    blocks = batch_of(spark, (5, [receipt("0x1a")]), (6, [receipt("0x2a", "0x3a", "0x1a")]), (7, [receipt("0x4a")]))
    out = ingest_batch(store, blocks, answers, limits)
    assert (out.blocks, out.stopped, out.progress, out.pending) == (3, "budget", 5, 2)  # blocks in their order
    assert drain(store, answers, limits).pending == 2  # the day's budget is spent
    out = drain(store, answers, limits)
    assert (out.progress, out.pending, store.spent("d1"), store.spent("d2")) == (7, 0, 160, 160)


def test_a_batch_that_fails_halfway_runs_again(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    ingest_batch(store, batch_of(spark, (1, [receipt("0xa")])), answers)
    store.add_seed("0xa", "bad")
    rows = batch_of(spark, (2, [receipt("0xb", "0xe")]))
    write = Store.write
    for failing in ("addresses", "events", "progress"):
        with monkeypatch.context() as m:
            m.setattr(Store, "write", lambda self, name, *a: (_ for _ in ()).throw(OSError(name)) if name == failing else write(self, name, *a))
            with pytest.raises(OSError):
                ingest_batch(store, rows, answers, batch="q-1")
        assert set(stored(store)) == {"0xa"} and store.read("events").count() == 0 and store.progress() == 1
    for _ in range(2):
        ingest_batch(store, rows, answers, batch="q-1")  # the second time it is known as done
        assert set(stored(store)) == {"0xa", "0xb", "0xe"} and store.progress() == 2
        assert [(r.id, r.kind, r.address) for r in store.read("events").collect()] == [(1, "ALERT", "0xb")]


def test_proxies_upgrades_and_their_alerts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest_batch(store, batch_of(spark, (1, [receipt("0xa")])), answers)
    store.add_seed("0xa", "bad")
    word = lambda address: F.concat(F.lit("0x" + "0" * 24), F.lit(address))
    one, two = "1" * 39 + "b", "2" * 39 + "e"

    def slots(rows):
        impl = F.when(F.col("address") == "0x1p", F.when(F.col("block") < 4, word(one)).otherwise(word(two))).when(F.col("address") == "0x3p", F.lit(None)).otherwise(F.lit("0x" + "0" * 64))
        return rows.withColumn("word", F.when(F.col("slot") == "implementation", impl).otherwise(word("3" * 39 + "a")))

    ingest_batch(store, batch_of(spark, (2, [receipt(created="0x1p"), receipt("0x2p", "0x3p")])), answers, get_slot=slots)
    assert {r.address: r.implementation for r in store.implementations().collect()} == {"0x1p": "0x" + one, "0x2p": "0x" + "3" * 39 + "a"}
    assert stored(store)["0x" + one] == (True, "impl", 2) and "0x" + "3" * 39 + "a" not in stored(store)  # a beacon is not fetched
    events = [(r.kind, r.block, r.address, r.origin) for r in store.read("events").orderBy("id").collect()]
    assert events == [("ALERT", 2, "0x" + one, "impl"), ("ALERT", 2, "0x1p", "created")]
    ingest_batch(store, batch_of(spark, (3, [receipt("0x1p")]), (4, [receipt("0x1p", "0x2p")]), (5, [receipt("0x1p")])), answers, get_slot=slots, watch=1.1)
    rows = store.read("events").orderBy("id")
    assert [(r.id, r.kind, r.block, r.address, r.old_impl, r.new_impl) for r in rows.collect()[2:]] == [(3, "UPGRADE", 4, "0x1p", "0x" + one, "0x" + two)]
    assert [r.line.split("\t")[0] for r in ingest.lines(rows, "created").orderBy("id").collect()] == ["ALERT", "UPGRADE"]
    assert {r.kind: r.n for r in ingest.event_counts(rows).collect()} == {"ALERT": 2, "UPGRADE": 1}
    assert stored(store)["0x" + two] == (False, "impl", 4)


def test_old_files_and_a_store_for_reading(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    old = "code_id string, size long, skeleton_hash string, selectors array<string>, hx string"
    rows = spark.createDataFrame([("c1", 3, "s", [], PROXY), ("c2", 1, "s", [], CODE)], old)
    rows.write.parquet(f"{store.folder}/codes/batch=old")
    store.commit("old")
    assert {r.code_id: r.std_proxy for r in store.codes().collect()} == {"c1": True, "c2": False}
    assert store.fingerprints().columns == [c.split()[0] for c in SCHEMAS["codes"].split(", ") if c.split()[0] not in ("hx", "ops", "runs")]
    assert store.code_by_id("C1").count() == 1 and not store.has_address("0xa") and store.code_of("0xa").count() == 0
    reader = Store(spark, store.folder, readonly=True)
    with pytest.raises(PermissionError):
        reader.add_seed("0xa", "x") if reader.has_address("0xa") else reader.set_progress(1, "x")
    assert reader.progress() is None and Store(spark, str(tmp_path / "none"), readonly=True).known().count() == 0


class Node(BaseHTTPRequestHandler):
    blocks = {1: [["0x" + "a" * 40]], 2: [], 3: [["0x" + "0" * 39 + "b", "0x" + "0" * 39 + "a"]]}
    top = 3

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        method, params = asked["method"], asked["params"]
        if method == "eth_blockNumber":
            result = hex(self.top)
        elif method == "eth_getBlockReceipts":
            result = [{"to": r[0], "logs": [{"address": a} for a in r[1:]]} for r in self.blocks[int(params[0], 16)]]
        elif method == "eth_getStorageAt":
            result = "0x" + "0" * 64
        else:
            result = "0x" + CODE if params[0].endswith("a") else "0x"
        body = json.dumps({"id": 1, "jsonrpc": "2.0", "result": result}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def node():
    server = HTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_backfill_and_listen(spark, tmp_path, node):
    store = Store(spark, str(tmp_path / "store"))
    get_code, get_slot = rpc.code_fetcher(node, workers=3), rpc.slot_fetcher(node)
    out = backfill(store, node, 1, 2, get_code, Limits(prices={"eth_getCode": 80, "eth_getBlockReceipts": 1000}, day="d"), get_slot=get_slot)
    assert (out.blocks, out.stopped, out.progress) == (2, None, 2) and store.spent("d") == 2080
    query = listen(spark, store, node, str(tmp_path / "checkpoint"), get_code, every="1 second", get_slot=get_slot)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert set(stored(store)) == {"0x" + "a" * 40, "0x" + "0" * 39 + "a", "0x" + "0" * 39 + "b"} and store.progress() == 3
    assert backfill(store, node, 1, 3, get_code, Limits(budget=10, prices={"eth_getBlockReceipts": 1000})).stopped == "budget"
    with pytest.raises(rpc.RpcError):
        rpc.receipts_of(node, 1, lambda u, b: (200, b'{"result": null}'), sleep=lambda s: None)


def test_keys_of_nodes(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# NODE_KEY=no\nOTHER=1\nNODE_KEY = no\nNODE_KEY='k1'\n")
    assert rpc.node_url("http://n/{key}", "NODE_KEY", str(env)) == "http://n/k1"
    monkeypatch.setenv("NODE_KEY", "k2")
    assert rpc.node_url("http://n/{key}", "NODE_KEY", str(env)) == "http://n/k2"
    with pytest.raises(rpc.RpcError):
        rpc.node_url("http://n/{key}", "NO_SUCH_KEY", str(env))
