"""The server, the command line and the report over a small store."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from coderill import cli, report, serving
from coderill.operators import ingest
from coderill.plans import corpus
from coderill.queries import Store as Derived
from coderill.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """The derived corpus, as a store."""
    derived, out = Derived(spark, SF), Store(spark, str(tmp_path_factory.mktemp("store")))
    out.append("codes", derived.codes)
    out.append("addresses", derived.stored)
    out.append("implementations", derived.stored.filter("implementation IS NOT NULL").select("address", "implementation", "block", F.lit(1).alias("step")))
    out.append("seeds", derived.seeds.select("*", F.lit(1).alias("version"), F.lit(False).alias("removed")))
    alerts = derived.recheck().join(derived.stored.select("address", "block"), "address")
    changes = derived.stored.limit(1).select("block", "address", F.lit("0x1").alias("old_impl"), F.lit("0x2").alias("new_impl"))
    out.append("events", ingest.events(alerts, changes).withColumn("at", F.lit("2026-01-01T00:00:00Z")))
    out.set_progress(100, "2026-01-01T00:00:00Z")
    out.spend("2026-01-01", "eth_getCode", 80)
    return out


def get(url):
    try:
        with urllib.request.urlopen(url) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


def test_server(store, tmp_path):
    folder = tmp_path / "static"
    (folder / "assets").mkdir(parents=True)
    (folder / "index.html").write_text("<p>index")
    (folder / "assets" / "a.js").write_text("1")
    (tmp_path / "secret.txt").write_text("no")
    server = serving.server(store, port=0, folder=str(folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        assert get(f"{root}/") == (200, b"<p>index") and get(f"{root}/assets/a.js") == (200, b"1")
        for bad in ("/assets/../../secret.txt", "/assets/%2e%2e/%2e%2e/secret.txt", "/nothing", "/api/nothing", "/assets/"):
            assert get(root + bad)[0] == 404
        status, body = get(f"{root}/api/events?limit=2&after=0")
        assert status == 200 and len(json.loads(body)["events"]) == 2
        assert get(f"{root}/api/events?limit=+2")[0] == 400  # a plus is no space
        assert json.loads(get(f"{root}/api/health")[1])["progress"] == 100
        assert get(f"{root}/api/clusters?level=x")[0] == 400
        post = urllib.request.Request(f"{root}/api/health", b"{}", method="POST")
        assert get(post)[0] == 405
    finally:
        server.shutdown()
    assert serving.static(None, "/")[0] == 200 and serving.static(None, "/x") is None


def test_clusters_are_kept_for_a_minute(store, monkeypatch):
    now = [0.0]
    cache = serving.ClusterCache(60, lambda: now[0])
    first = cache.of(store, "L0")
    assert [r["n_members"] for r in first] == sorted((r["n_members"] for r in first), reverse=True) and all(len(r["members"]) == r["n_members"] for r in first)
    now[0] = 59.0
    assert cache.of(store, "L0") is first
    now[0] = 60.0
    assert cache.of(store, "L0") is not first and cache.of(store, "L0") == first
    monkeypatch.setattr(serving, "health", lambda _: 1 / 0)
    assert serving.respond(store, "/api/health") == (500, {"error": "division by zero"})


def lines(capsys, store, *words):
    assert cli.main(["--store", store.folder, *words]) == 0
    return [line.split("\t") for line in capsys.readouterr().out.splitlines()]


def test_command_line(store, capsys, tmp_path):
    top = lines(capsys, store, "clusters", "--n", "3")
    assert len(top) == 3 and all(len(r) == 3 for r in top)
    flagged = lines(capsys, store, "risk")
    assert flagged and {r[1] for r in flagged} <= {"selfdestruct", "mutable_delegatecall", "selfdestruct,mutable_delegatecall"}
    assert {r[1] for r in lines(capsys, store, "risk", "--flag", "selfdestruct")} == {"selfdestruct"}
    address = flagged[0][0]
    assert all(len(r) == 4 and r[3] == flagged[0][1] for r in lines(capsys, store, "cluster", address))
    near = lines(capsys, store, "similar", address, "--min", "0.5")
    assert near and all(len(r) == 3 and 0.5 <= float(r[1]) <= 1 for r in near)
    alerts = lines(capsys, store, "recheck")
    assert alerts and all(r[0] == "ALERT" and len(r) == 6 for r in alerts)
    assert all(r[5] == "created" for r in lines(capsys, store, "recheck", "--origin", "created"))
    seeds = lines(capsys, store, "seed", "list")
    assert seeds and all(len(r) == 4 and r[3] in ("strict", "loose") for r in lines(capsys, store, "seed", "audit"))
    assert cli.main(["--store", store.folder, "seed", "add", "0x" + "0" * 40]) == 2
    labels = tmp_path / "labels.json"
    labels.write_text(json.dumps({"positives": [[seeds[0][0], seeds[1][0]], [seeds[0][0], "0x" + "0" * 40]], "negatives": [], "strict": []}))
    grid = lines(capsys, store, "calibrate", str(labels), "--grid", "0.5,1")
    assert [float(r[0]) for r in grid] == [0.5, 1.0] and all(len(r) == 6 for r in grid)
    with pytest.raises(SystemExit):
        cli.main(["--store", store.folder, "similar", "0x1"])


def test_report(store, tmp_path):
    from coderill.operators import codes

    stored, held = store.addresses(), store.codes()
    data = report.collect(stored, held, store.seeds(), codes.effective(stored, held), store.read("ledger"))
    paths = report.write(data, str(tmp_path / "r"))
    first = [open(p, "rb").read() for p in paths]
    assert report.write(data, str(tmp_path / "r")) == paths and [open(p, "rb").read() for p in paths] == first
    assert json.loads(first[0]) == json.loads(json.dumps(data)) and first[0].endswith(b"}\n")
    page = first[1].decode()
    assert page.count("<svg") == 5 and "url(#none)" not in page.split("</defs>")[0] and 'src="' not in page and "n/a" in page or "1.0000" in page
    assert report.bars([0, 3, 1000], ["a", "b", "c<"], "t", log=True).count("<rect") == 3 and "c&lt;" in report.bars([1], ["c<"], "t")


def test_raw_codes_are_whole(spark):
    """The corpus takes whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    assert corpus.raw_codes(spark, SF).agg(F.max(F.length("hx"))).first()[0] >= 2 * longest
