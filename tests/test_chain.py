"""Passes over a chain under a ledger, codes at their block, bounded batches, fetched seeds, and the command line's answers."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from coderill import cli
from coderill.functions.bytecode import IMPLEMENTATION_SLOT
from coderill.operators import ingest
from coderill.sources import rpc
from coderill.sources.blocks import BlockReader
from coderill.sources.store import Store
from coderill.streaming.follow import Limits, follow_chain, watch_chain

CODE = "6080604052" + "".join(f"8063{i:08x}146100ff57" for i in range(8))
PROXY = f"60806040527f{IMPLEMENTATION_SLOT}54f4"
PRICES = {"eth_blockNumber": 80, "eth_getBlockReceipts": 1000, "eth_getCode": 80, "eth_getStorageAt": 80}
address = lambda tail: "0x" + tail.rjust(40, "0")


class Node(BaseHTTPRequestHandler):
    """Blocks 1 to 4 touch a proxy, whose implementation changes from block 3 on, and a contract of their own."""

    top, calls, broken = 4, [], False

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        method, params = asked["method"], asked["params"]
        type(self).calls.append((method, *params))
        result, at = None, lambda: self.top if params[-1] == "latest" else int(params[-1], 16)
        if method == "eth_blockNumber":
            result = hex(self.top)
        elif method == "eth_getBlockReceipts":
            result = [{"to": address("dd"), "logs": [{"address": address(f"{int(params[0], 16)}c")}]}]
        elif method == "eth_getStorageAt":
            result = "0x" + address("1c" if at() < 3 else "2c")[2:].rjust(64, "0")
        elif method == "eth_getCode":
            result = {"dd": "0x" + PROXY, "ee": "0x", "ff": "oops"}.get(params[0][-2:], "0x" + CODE)
        body = json.dumps({"id": 1, "jsonrpc": "2.0", "result": result} if not (self.broken and method == "eth_getBlockReceipts") else {"id": 1, "error": {"code": -1, "message": "no"}}).encode()
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
    Node.calls, Node.broken, Node.top = [], False, 4
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_passes_at_their_blocks_and_to_the_head(spark, tmp_path, node):
    store = Store(spark, str(tmp_path / "s"))
    get_code, get_slot = rpc.code_fetcher(node, tag=None), rpc.slot_fetcher(node, tag=None)
    sizes = []
    out = follow_chain(store, node, get_code, Limits(prices=PRICES, day="d"), 1, 99, step=3, told=lambda: sizes.append(store.progress()), get_slot=get_slot)
    assert (out.blocks, out.stopped, out.progress, sizes) == (4, None, 4, [3, 4])
    assert [(r.block, r.old_impl, r.new_impl) for r in store.read("events").filter("kind = 'UPGRADE'").collect()] == [(3, address("1c"), address("2c"))]
    counted = {m: sum(c[0] == m for c in Node.calls) for m in PRICES}
    assert counted["eth_getBlockReceipts"] == 4 and counted["eth_blockNumber"] == 1
    assert store.spent("d") == sum(PRICES[m] * n for m, n in counted.items())


def test_the_ledger_stops_a_watch(spark, tmp_path, node):
    store, days = Store(spark, str(tmp_path / "s")), ["d"]
    out = watch_chain(store, node, rpc.code_fetcher(node, tag=None), Limits(budget=2600, prices=PRICES, day=lambda: days[0]), sleep=lambda s: pytest.fail("it goes on"), first=1, step=100)
    assert out.stopped == "budget" and out.progress == 2 and store.spent("d") <= 2600
    assert sum(c[0] == "eth_getBlockReceipts" for c in Node.calls) == 2
    asked = len(Node.calls)
    while store.spent("d") <= 2600 - 80:
        store.spend("d", "x", 40)
    assert watch_chain(store, node, rpc.code_fetcher(node), Limits(budget=2600, prices=PRICES, day="d")).stopped == "budget" and len(Node.calls) == asked  # not even the head


def test_bounded_offsets(node):
    reader = BlockReader({"url": node, "start": "1", "most": "2"})
    Node.top = 10_000
    at, seen = reader.initialOffset(), []
    for _ in range(3):
        end = reader.latestOffset()
        assert end == reader.latestOffset()
        seen.append(sum(p.stop - p.first for p in reader.partitions(at, end)))
        at = end
    assert seen == [2, 2, 2] and at == {"next": 7}
    Node.top = 3  # a node that is behind
    assert reader.latestOffset() == {"next": 7} and all(p.first >= p.stop for p in reader.partitions(at, {"next": 7}))
    later = BlockReader({"url": node, "start": "1", "at": "7", "most": "2"})
    Node.top = 10_000
    assert later.latestOffset() == {"next": 9}


def test_reserved_reads_stay_below_the_budget(spark):
    rng = random.Random(9)
    for _ in range(12):
        reads = sorted({(rng.randrange(6), address(f"{rng.randrange(9):x}")) for _ in range(rng.randint(0, 30))})
        left, price = rng.choice([None, 0, 100, 900, 2500, -5]), rng.choice([0, 80, 160])
        got = sorted((r.block, r.address) for r in ingest.reserved(spark.createDataFrame(reads, "block long, address string"), left, price).collect())
        want, spent = [], 0
        for read in reads:
            if left is not None and price and spent + price > max(0, left):
                break
            spent += price
            want.append(read)
        assert got == want


def test_command_line(spark, tmp_path, node, capsys):
    store = str(tmp_path / "s")
    run = lambda *words: cli.main(["--store", store, *words])
    asked = lambda: len(Node.calls)
    assert run("seed", "add", address("1c"), "--label", "x") == 2 and "unknown address or no code" in capsys.readouterr().err
    assert run("seed", "add", address("ff"), "--label", "x", "--fetch", "--node", node) == 1 and "no code" in capsys.readouterr().err
    assert run("seed", "add", address("ee"), "--label", "x", "--fetch", "--node", node) == 2
    before = asked()
    assert run("seed", "add", address("dd"), "--label", "bad", "--fetch", "--node", node) == 0
    assert [c[0] for c in Node.calls[before:]] == ["eth_blockNumber", "eth_getCode", "eth_getStorageAt", "eth_getCode"]
    rows = {r.address: (r.origin, r.implementation) for r in Store(spark, store).addresses().collect()}
    assert rows == {address("ee"): ("fetched", None), address("dd"): ("fetched", address("2c")), address("2c"): ("impl", None)}
    held = asked()
    assert run("seed", "add", address("dd"), "--label", "again", "--fetch", "--node", node) == 0 and asked() == held
    capsys.readouterr()
    assert run("backfill", "--node", node, "--from", "1", "--to", "9", "--plan", "free", "--daily-budget", "5") == 2
    assert run("backfill", "--node", node, "--from", "1", "--to", "9", "--plan", "metered", "--daily-budget", "1500", "--step", "5") == 3
    said = capsys.readouterr()
    assert "stopped: budget, spent " in said.err and "credits, progress 1" in said.err and said.out.startswith("ALERT\t")
    Node.broken = True
    assert run("backfill", "--node", node, "--from", "2", "--to", "2", "--plan", "free") == 1
    assert len(capsys.readouterr().err.strip().splitlines()) >= 1 and Store(spark, store).progress() == 1
    assert run("listen", "--node", "http://127.0.0.1:9/{key}", "--key-variable", "NO_SUCH_KEY") == 1
