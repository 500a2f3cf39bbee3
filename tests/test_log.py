"""The store's log, generations, buckets and tallies."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from coderill.operators import clusters, statistics
from coderill.sources import views
from coderill.sources.log import Log, Part
from coderill.sources.store import KEYS, SCHEMAS, Store, buckets

ADDRESSES, CODES, IMPLEMENTATIONS = SCHEMAS["addresses"], SCHEMAS["codes"], SCHEMAS["implementations"]


def test_log_and_snapshots(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.state().step == 0 and not log.state().done("q-0")
    log.commit("q-0", [Part("codes", "codes/a")])
    log.commit("other", [Part("codes", "codes/b"), Part("events", "events/b")])
    assert log.commit("q-7", []).step == 3
    for _ in range(2):
        state = Log(spark, log.folder).state()
        assert [p.path for p in state.of("codes")] == ["codes/a", "codes/b"] and state.step == 3
        assert all(map(state.done, ("q-0", "q-3", "q-7", "other"))) and not any(map(state.done, ("q-8", "p-1", "x")))
        log.snapshot()
        log.trim()
    assert [n for n, _ in log.listed(log.folder) if not n.startswith(".")] == ["000000000003.all.json"]
    log.commit(None, [Part("codes", "codes/c", 1)], ["codes/a", "codes/b"])
    assert [p.path for p in log.state().of("codes")] == ["codes/c"] and [p.path for p in log.state().of("events")] == ["events/b"]
    with pytest.raises(FileExistsError):
        log.commit("late", [], step=4)


def test_folders_of_many_batches(spark, tmp_path, monkeypatch):
    """After 500 batches some tens of folders, whose rows are those of all batches in order."""
    store, held = Store(spark, str(tmp_path / "s")), {}

    def merged(self, parts, level):
        path = f"{parts[0].table}/{level}-{len(held)}"
        held[path] = [x for p in parts for x in held.get(p.path, [p.path])]
        return Part(parts[0].table, path, level)

    monkeypatch.setattr(Store, "_merged", merged)
    for k in range(500):
        store.log.commit(f"q-{k}", [Part(t, f"{t}/{k}") for t in ("addresses", "events")])
        store.compact()
    for table in ("addresses", "events"):
        parts = store.state().of(table)
        assert sorted(x for p in parts for x in held.get(p.path, [p.path])) == sorted(f"{table}/{k}" for k in range(500))
        assert len(parts) == 500 // 256 + 500 % 256 // 16 + 500 % 16 and sum(buckets(p.level) for p in parts) <= 50
    assert len(store.log.listed(store.log.folder)) < 120


def filled(spark, folder, n=1_000_000, fresh=40):
    """A store of many addresses in buckets, and some batches after that."""
    store = Store(spark, folder)
    rows = spark.range(n).select(F.concat(F.lit("0x"), F.left(F.sha2(F.col("id").cast("string"), 256), F.lit(40))).alias("address"), F.concat(F.lit("c"), F.col("id") % 5000).alias("code_id"), F.col("id").alias("block"), F.lit("seen").alias("origin"))
    store.load({"addresses": rows})
    for k in range(3):
        store.append("addresses", rows.limit(0).unionByName(spark.createDataFrame([(f"0xnew{k}{i}", "c1", n + k, "created") for i in range(fresh)], ADDRESSES)))
    return store


def rows_read(frame):
    return metric(frame, "numOutputRows", "Scan")


def files_read(frame):
    return metric(frame, "numFiles")


def metric(frame, name, of=""):
    frame.collect()
    plan, seen = frame._jdf.queryExecution().executedPlan(), 0
    stack = [plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan]
    while stack:
        node = stack.pop()
        metrics = node.metrics()
        if metrics.contains(name) and of in node.nodeName():
            seen += metrics.apply(name).value()
        children = [node.children().apply(k) for k in range(node.children().size())]
        if "QueryStage" in node.getClass().getSimpleName():
            children.append(node.plan())
        stack += children
    return seen


def test_point_reads_open_their_buckets(spark, tmp_path):
    store = filled(spark, str(tmp_path / "s"))
    address = lambda k: "0x" + hashlib.sha256(str(k).encode()).hexdigest()[:40]
    all_files = files_read(store.read("addresses"))
    one = store.among("addresses", [address(77)])
    assert [r.block for r in one.collect()] == [77] and files_read(one) <= 1 + 3 and all_files >= buckets(2) + 3
    asked = spark.createDataFrame([(address(k * 31),) for k in range(5)] + [("0xnew11",), ("0xnone",), (None,)], "address string")
    some = store.among("addresses", asked)
    assert sorted(r.block for r in some.collect()) == [0, 31, 62, 93, 124, 1_000_001] and files_read(some) <= 7 + 3
    assert {r.address: r.stored for r in store.stored(asked).collect()} == {r.address: r.address != "0xnone" for r in asked.collect() if r.address}
    assert store.has_address(address(5).upper().replace("X", "x")) and not store.has_address("0xnone")
    assert store.holders_of(spark.createDataFrame([("c7",)], "code_id string")).count() == 200
    # a key that lies between those of its bucket: the file's Bloom filter leaves no row to read
    scanned = spark.read.parquet(f"{store.folder}/{store.state().of('addresses')[0].path}").filter(F.col("address") == "0x8000000000000000000000000000000000000000")
    assert rows_read(scanned) == 0 and rows_read(scanned.sparkSession.read.parquet(f"{store.folder}/{store.state().of('addresses')[0].path}").filter("block = 500000")) > 0


def random_batch(rng, n):
    """Rows of addresses and implementations, with repeats, late blocks and proxies."""
    a = [(f"0x{rng.randrange(60)}", rng.choice([None, "p0", "p1", "k0", "k1", "k2", "d0"]), rng.randrange(1, 3 * n + 2), rng.choice(["seen", "created", None])) for _ in range(rng.randint(0, 12))]
    i = [(f"0x{rng.randrange(60)}", f"0x{rng.randrange(8)}", rng.randrange(1, 3 * n + 2), n) for _ in range(rng.randint(0, 5))]
    return a, i


def test_tallies_are_what_a_count_anew_gives(spark, tmp_path):
    rng, store = random.Random(11), Store(spark, str(tmp_path / "s"), fanout=5)
    row = lambda c: (c, 1, "s" if c[0] == "k" else c, ["0x1"], "eip1167" if c == "d0" else None, "0xt" if c == "d0" else None, c[0] == "p", False, False, [], [], "00", 1)
    store.write("codes", spark.createDataFrame([row(c) for c in ("p0", "p1", "k0", "k1", "k2", "d0")], CODES), "codes-0")
    store.commit("codes-0")
    same = lambda a, b: sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(b.columns)).collect()))
    for k in range(1, 51):
        a, i = random_batch(rng, k)
        if k % 7:
            store.write("addresses", spark.createDataFrame(a, ADDRESSES), f"q-{k}")
        if k % 3:
            store.write("implementations", spark.createDataFrame(i, IMPLEMENTATIONS).join(store.known().select("address"), "address", "left_semi"), f"q-{k}")
        store.commit(f"q-{k}")
        store.commit(f"q-{k}")  # done already
        stored, codes = store.addresses(), store.codes()
        anew = views.differences(store, store.read("addresses"), store.read("implementations"), anew=True)
        kept = views.MERGES["tallies"](store.read("tallies"))
        assert same(kept, anew), k
    assert same(views.sizes(store), clusters.sizes(stored, codes)) and views.sizes(store).count() > 5
    assert same(views.counts(store), statistics.counts(stored, codes))
    assert same(views.origin_counts(store), statistics.origin_counts(stored)) and same(views.origin_counts(store, 40), statistics.origin_counts(stored, 40))
    assert same(views.levels(store), statistics.levels(clusters.sizes(stored, codes), stored))
    assert views.resolved(store) == stored.filter("implementation IS NOT NULL").count()
    everything = clusters.build(stored, codes)
    assert same(views.members(store, views.sizes(store)), everything)
    rows = everything.select("level", "key", F.explode("members").alias("address"))
    paged = views.pages(rows, 3).collect()
    want = {(r.level, r.key): r.members for r in everything.collect()}
    assert all(len(r.members) <= 3 for r in paged)
    assert {k: sum((r.members for r in sorted(paged, key=lambda r: r.page) if (r.level, r.key) == k), []) for k in want} == want


def test_a_merge_that_fails_and_readers_meanwhile(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), fanout=4)
    row = lambda k: spark.createDataFrame([(f"0x{k % 5}", f"c{k}", 100 - k, "seen")], ADDRESSES)
    for k in range(3):
        store.write("addresses", row(k), f"q-{k}")
        store.commit(f"q-{k}")
    reader = Store(spark, store.folder, readonly=True)
    plan, rows = reader.known(), sorted(reader.known().collect())
    commit = Log.commit

    def failing(self, batch, add, remove=(), step=None):
        if remove:
            raise OSError("halfway")
        return commit(self, batch, add, remove, step)

    monkeypatch.setattr(Log, "commit", failing)
    store.write("addresses", row(3), "q-3")
    with pytest.raises(OSError):
        store.commit("q-3")
    monkeypatch.undo()
    after = sorted(reader.known().collect())
    assert len(after) == 4 and store.committed("q-3") and len(reader.state().of("addresses")) == 4
    store.compact()
    assert [p.level for p in reader.state().of("addresses")] == [1] and sorted(reader.known().collect()) == after
    assert sorted(plan.collect()) == rows  # folders of a plan stay
    gone = store.vacuum(0)
    assert len([g for g in gone if g.startswith("addresses/")]) == 5 and sorted(reader.known().collect()) == after  # four batches and the failed merge
    assert reader.committed("q-0") and Store(spark, store.folder).step() == store.step()
    with pytest.raises(PermissionError):
        reader.compact() if not reader.readonly else reader.vacuum()
    assert set(KEYS) <= set(SCHEMAS)
