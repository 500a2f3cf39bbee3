"""Following the chain: receipts as a stream, a micro-batch at a time into the store.

Receipts are rows (block, receipt as JSON text) of files, of the ``blocks`` source or of any DataFrame. Codes and storage
slots come from functions of rows, so that the node, a file or a test can give them. A batch of any blocks in any order

1. takes the candidates of its blocks and those that earlier batches left,
2. decides which codes to fetch under a cap for each block and a budget of credits for the day; the others are left
   to later batches in the ``deferred`` table, and progress never reaches the least block of them,
3. stores codes and addresses, and matches the new codes with the watchlist,
4. reads the slots of standard proxies that are new or touched, at each block that touches them, stores the codes of new implementations, and finds
   upgrades and the alerts of implementations (with the default threshold, whatever ``watch`` is),
5. writes alerts, then upgrades, as events, the calls to the ledger, and progress.

All tables of a batch are written under its name and become visible with one commit. A batch that failed anywhere
runs again from the state before it and overwrites what it left; one that was committed is not run again. The calls of
a failed attempt are not in the ledger. The first record of an address is that of its least block, whatever order files
come in; a failed read stores nothing, and the address is read again when a later block touches it.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coderill.functions.similarity import ALERT_MIN
from coderill.operators import codes, ingest, similarity
from coderill.sources import rpc
from coderill.sources.store import Store

GetCode = Callable[[DataFrame], DataFrame]
"""From (address, block, origin) to the same rows with ``answer``, null where the read failed."""

GetSlot = Callable[[DataFrame], DataFrame]
"""From (address, block, slot) to the same rows with ``word``, null where the read failed; slots are implementation and beacon."""


@dataclass
class Limits:
    """``cap`` fetches a block; credits a day and a call, by method; ``day`` is a text, a function, or today in UTC."""

    cap: int | None = None
    budget: int | None = None
    prices: dict[str, int] = field(default_factory=dict)
    day: str | Callable[[], str] | None = None

    def today(self) -> str:
        return self.day if isinstance(self.day, str) else self.day() if self.day else datetime.now(UTC).strftime("%Y-%m-%d")

    def calls(self, method: str, spent: int) -> int | None:
        """How many calls the rest of the budget pays; none: any number."""
        price = self.prices.get(method, 0)
        return None if self.budget is None or price <= 0 else max(0, (self.budget - spent) // price)


@dataclass
class Outcome:
    """What a batch did: number of blocks, ``cap`` or ``budget`` if it left candidates, progress, what it left, and the day that it was charged to."""

    blocks: int = 0
    stopped: str | None = None
    progress: int | None = None
    pending: int = 0
    day: str | None = None


def _stored(answers: DataFrame) -> DataFrame:
    code = F.when(F.col("kind") == "contract", F.sha2(F.unhex("hx"), 256))
    return answers.filter("kind <> 'failed'").select("address", code.alias("code_id"), "block", "origin")


Held = Callable[[DataFrame, str], DataFrame]


def _words(targets: DataFrame, get_slot: GetSlot, credits: int | None, limits: Limits, held: Held) -> tuple[DataFrame, int]:
    """Slot words (address, block, slot, word) of proxies (address, block), beacons only where the first read gave no address, and the number of calls.

    Of ``credits``, a first read reserves its own price and that of the code that it may name, in order of block and address; a
    beacon's has what remains when these codes are paid.
    """
    slot_price, code_price = (limits.prices.get(m, 0) for m in ("eth_getStorageAt", "eth_getCode"))
    first = held(get_slot(ingest.reserved(targets, credits, slot_price + code_price).withColumn("slot", F.lit("implementation"))), "impl_words")
    n = first.count()
    found = ingest.resolved(first, first, ("address", "block"))
    if credits is not None:
        named = found.filter("implementation IS NOT NULL").agg(F.count_distinct("implementation")).first()[0]
        credits -= n * slot_price + named * code_price
    open_words = found.filter("implementation IS NULL").join(first.filter("word IS NOT NULL").select("address", "block"), ["address", "block"], "left_semi")
    second = held(get_slot(ingest.reserved(open_words.select("address", "block"), credits, slot_price).withColumn("slot", F.lit("beacon"))), "beacon_words")
    return first.unionByName(second), n + second.count()


def _alerts(matched: DataFrame, where: DataFrame) -> DataFrame:
    return matched.join(where, "code_id").select("block", "address", "seed_address", "label", "score", "origin")


def ingest_batch(
    store: Store, receipts: DataFrame, get_code: GetCode, limits: Limits | None = None, watch: float = ALERT_MIN, now: str | None = None,
    get_slot: GetSlot | None = None, batch: str | None = None, ahead: dict[str, int] | None = None,
) -> Outcome:
    """One batch of receipts; ``ahead`` are calls by method that were made for it already.

    What a batch reads of addresses and codes is what its candidates, their implementations and the seeds need.
    """
    batch, limits = batch or uuid.uuid4().hex, limits or Limits()
    at = now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    if store.committed(batch):
        return Outcome(progress=store.progress())
    day, step = limits.today(), store.step()
    calls = dict(ahead or {})
    held: Held = lambda frame, name: store.scratch(frame, batch, name)

    def spent() -> int:
        return store.spent(day) + sum(limits.prices.get(m, 0) * n for m, n in calls.items())

    found = held(ingest.candidates(ingest.touched(receipts)), "found")
    left = held(store.pending(), "left")
    waiting = found.select("address", "block", "origin").unionByName(left.select("address", "block", "origin"))
    known = held(store.known(waiting.select("address")), "known")
    # a record of an earlier block than the stored one, which needs no fetch
    sooner = ingest.first_seen(found).join(known.select("address", "code_id", F.col("block").alias("later")), "address").filter("block < later").drop("later")
    allowed = limits.calls("eth_getCode", spent())
    decided = held(ingest.capped(ingest.first_seen(ingest.unknown(waiting, known)), limits.cap, allowed), "decided")
    answers = held(ingest.classified(get_code(decided.filter("fetched").select("address", "block", "origin"))), "answers")
    calls["eth_getCode"] = calls.get("eth_getCode", 0) + answers.count()
    stored, new_codes = _stored(answers), held(codes.fingerprints(answers.filter("kind = 'contract'")), "new_codes")
    seeds = store.seeds()
    used = stored.select("code_id").unionByName(known.select("code_id")).unionByName(seeds.select("code_id")).distinct()
    old_codes = held(store.codes(used), "old_codes")
    new_codes = new_codes.join(old_codes.select("code_id"), "code_id", "left_anti")
    here = old_codes.unionByName(new_codes, allowMissingColumns=True)
    matched = similarity.match(here.join(stored.select("code_id"), "code_id", "left_semi"), here, seeds, watch)
    alerts = _alerts(matched, stored)
    upgraded = store.read("events").limit(0).select("block", "address", "old_impl", "new_impl")
    if get_slot is not None:
        alerts = held(alerts, "alerts")
        proxies = here.filter("std_proxy").select("code_id")
        new_proxies = held(stored.join(proxies, "code_id", "left_semi"), "new_proxies")
        # every block that touches a proxy, whether it was known before or is new in this batch
        every = known.join(proxies, "code_id", "left_semi").select("address").unionByName(new_proxies.select("address")).distinct()
        again = found.join(every, "address", "left_semi")
        targets = new_proxies.select("address", "block").unionByName(again.select("address", "block")).distinct()
        credits = None if limits.budget is None else max(0, limits.budget - spent())
        words, n = _words(targets, get_slot, credits, limits, held)
        calls["eth_getStorageAt"] = calls.get("eth_getStorageAt", 0) + n
        resolved = held(ingest.resolved(targets, words, ("address", "block")).filter("implementation IS NOT NULL"), "resolved")
        upgraded = held(ingest.changes(resolved, store.implementations(resolved.select("address"))), "upgraded")
        # codes of implementations that a slot named and nobody holds yet
        behind = resolved.select(F.col("implementation").alias("address")).distinct()
        held_behind = held(store.known(behind).select("address", "code_id").unionByName(stored.join(behind, "address", "left_semi").select("address", "code_id")), "held_behind")
        named = resolved.filter("direct").groupBy(F.col("implementation").alias("address")).agg(F.min("block").alias("block"))
        asked = named.join(held_behind.select("address"), "address", "left_anti").select("address", "block", F.lit("impl").alias("origin"))
        side = held(ingest.classified(get_code(asked)), "side")
        calls["eth_getCode"] += side.count()
        side_stored, side_codes = _stored(side), held(codes.fingerprints(side.filter("kind = 'contract'")), "side_codes")
        ids = held_behind.select("code_id").unionByName(side_stored.select("code_id")).distinct()
        behind_codes = held(store.codes(ids).join(here.select("code_id"), "code_id", "left_anti"), "behind_codes")
        here = here.unionByName(behind_codes, allowMissingColumns=True)
        side_codes = side_codes.join(here.select("code_id"), "code_id", "left_anti")
        here = here.unionByName(side_codes, allowMissingColumns=True)
        everyone = held_behind.unionByName(side_stored.select("address", "code_id")).withColumnRenamed("address", "implementation")
        through = resolved.join(new_proxies.select("address", "block", "origin"), ["address", "block"]).join(everyone, "implementation").filter("code_id IS NOT NULL")
        shown = through.select("block", "address", "origin", "code_id").unionByName(side_stored.filter("code_id IS NOT NULL").select("block", "address", "origin", "code_id")).distinct()
        more = _alerts(similarity.match(here.join(shown.select("code_id"), "code_id", "left_semi"), here, seeds), shown)
        alerts = alerts.unionByName(more)
        stored, new_codes = stored.unionByName(side_stored), new_codes.unionByName(side_codes, allowMissingColumns=True)
        store.write("implementations", resolved.withColumn("step", F.lit(step)), batch)
    store.write("codes", new_codes, batch)
    store.write("addresses", stored.unionByName(sooner.select(*stored.columns)), batch)
    last = store.read("events").agg(F.max("id")).first()[0] or 0
    store.write("events", ingest.events(alerts, upgraded, last).withColumn("at", F.lit(at)), batch)
    deferred = decided.join(left.select("address", F.lit(True).alias("before")), "address", "left").filter("NOT fetched OR before")
    gone = left.join(decided.select("address"), "address", "left_anti").select("address", "block", "origin", F.lit(False).alias("pending"))  # known by now
    store.write("deferred", deferred.select("address", "block", "origin", (~F.col("fetched")).alias("pending")).unionByName(gone).withColumn("step", F.lit(step)), batch)
    charged = [(day, m, n * limits.prices.get(m, 0)) for m, n in calls.items() if n]
    store.write("ledger", store.spark.createDataFrame(charged, "day string, method string, credits long"), batch)
    # progress stops before the least block that is not complete
    top, n_blocks = receipts.agg(F.max("block"), F.count_distinct("block")).first()
    least, pending = decided.filter("NOT fetched").agg(F.min("block"), F.count(F.lit(1))).first()
    before, furthest = store.read("progress").agg(F.max("block"), F.max("seen")).first()
    seen = max((b for b in (top, before, furthest) if b is not None), default=None)
    done = seen if least is None else least - 1
    moved = done is not None and done >= 0 and (before is None or done > before)
    store.write("progress", store.spark.createDataFrame([(done if moved else None, at if moved else None, seen)], "block long, updated_at string, seen long"), batch)
    store.commit(batch, step)
    store.sweep(batch)
    by_budget = allowed is not None and (limits.cap is None or allowed < limits.cap)
    return Outcome(n_blocks, ("budget" if by_budget else "cap") if pending else None, store.progress(), pending)


def drain(store: Store, get_code: GetCode, limits: Limits | None = None, **options) -> Outcome:
    """Batches without receipts until nothing is left, or nothing more can be fetched."""
    none = store.spark.createDataFrame([], "block long, receipt string")
    before, out = store.pending().count(), Outcome(progress=store.progress())
    while before:
        out = ingest_batch(store, none, get_code, limits, **options)
        if out.pending >= before:
            break
        before = out.pending
    return out


def _writer(stream: DataFrame, store: Store, checkpoint: str, get_code: GetCode, **options):
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def run(rows: DataFrame, number: int) -> None:
        ingest_batch(store, rows, get_code, batch=f"{name}-{number}", **options)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def follow(spark: SparkSession, store: Store, folder: str, checkpoint: str, get_code: GetCode, every: str | None = None, files: int = 1, **options) -> StreamingQuery:
    """All files of the folder so far, or with ``every`` those to come too, ``files`` of them each micro-batch."""
    stream = spark.readStream.schema("block long, receipt string").option("maxFilesPerTrigger", files).json(folder)
    writer = _writer(stream, store, checkpoint, get_code, **options)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def listen(spark: SparkSession, store: Store, url: str, checkpoint: str, get_code: GetCode, every: str = "12 seconds", start: int | None = None, most: int = 100, **options) -> StreamingQuery:
    """Blocks of a node as a stream, ``most`` of them a batch, from ``start``, else from progress on, else from the head.

    The receipts of a batch are read before it is known what they cost; ``watch_chain`` asks the ledger first.
    """
    from coderill.sources.blocks import BlockSource

    spark.dataSource.register(BlockSource)
    progress, seen = store.progress(), store.read("progress").agg(F.max("seen")).first()[0]
    first = start if start is not None else progress + 1 if progress is not None else None
    reader = spark.readStream.format("blocks").option("url", url).option("most", str(most))
    reader = reader if first is None else reader.option("start", str(first))
    stream = (reader if seen is None else reader.option("at", str(seen + 1))).load()
    return _writer(stream, store, checkpoint, get_code, **options).trigger(processingTime=every).start()


RPC_ERROR = re.compile(r"RpcError: ([^\n]*)")


def follow_chain(
    store: Store, url: str, get_code: GetCode, limits: Limits | None = None, first: int | None = None, last: int | None = None, step: int = 1,
    told: Callable[[], None] | None = None, **options,
) -> Outcome:
    """One pass up to the head, or to ``last`` where that is less, in batches of ``step`` blocks that the ledger allows.

    Starts at ``first``, else behind progress, else at the head. The poll of the head and the receipts are charged to the day, and not
    made where its budget does not pay for them. Stops at a batch that leaves candidates. ``told`` is called after each
    batch. A failed read of the node is an RpcError, and leaves nothing of its batch.
    """
    limits, progress = limits or Limits(), store.progress()
    out = Outcome(progress=progress, day=limits.today())
    if limits.calls("eth_blockNumber", store.spent(out.day)) == 0:
        out.stopped = "budget"
        return out
    head, price = rpc.head(url), limits.prices.get("eth_blockNumber", 0)
    if price:
        store.spend(out.day, "eth_blockNumber", price)
    lo = first if first is not None else progress + 1 if progress is not None else head
    stop = head if last is None else min(last, head)
    while lo <= stop and out.stopped is None:
        day = limits.today()
        allowed = limits.calls("eth_getBlockReceipts", store.spent(day))
        n = min(step, stop - lo + 1) if allowed is None else min(step, stop - lo + 1, allowed)
        if not n:
            out.stopped, out.day = "budget", day
            break
        receipts = rpc.read_receipts(store.spark, url, range(lo, lo + n)).persist()
        try:
            got = ingest_batch(store, receipts, get_code, replace(limits, day=day), ahead={"eth_getBlockReceipts": n}, **options)
        except PySparkException as error:
            if found := RPC_ERROR.search(str(error)):
                raise rpc.RpcError(found[1]) from None
            raise
        finally:
            receipts.unpersist()
        out = Outcome(out.blocks + got.blocks, got.stopped, got.progress, got.pending, day)
        lo += n
        if told:
            told()
    return out


def watch_chain(store: Store, url: str, get_code: GetCode, limits: Limits | None = None, interval: float = 12, sleep: Callable[[float], None] = time.sleep, **options) -> Outcome:
    """Passes up to the head, ``interval`` seconds apart, until a limit stops one."""
    while (out := follow_chain(store, url, get_code, limits, **options)).stopped is None:
        sleep(interval)
    return out


def backfill(store: Store, url: str, first: int, last: int, get_code: GetCode, limits: Limits | None = None, step: int = 1, **options) -> Outcome:
    """Blocks of a node from first to last, or to the head, ``step`` of them a batch."""
    return follow_chain(store, url, get_code, limits, first, last, step, **options)


def fetch(store: Store, address: str, block: int, get_code: GetCode, get_slot: GetSlot) -> str:
    """Store an address by name as of ``block``, and what a standard proxy points to; returns contract, eoa or failed.

    An address that is stored is not read again; of a proxy, the implementation is read where none is known. A slot that fails or
    is empty leaves the proxy without one. Nothing is stored where the code cannot be read.
    """
    spark, address, batch = store.spark, address.lower(), uuid.uuid4().hex
    row = spark.createDataFrame([(address, block, "fetched")], "address string, block long, origin string")
    held: Held = lambda frame, name: store.scratch(frame, batch, name)
    known = store.has_address(address)
    if known:
        here, stored = store.code_of(address), row.limit(0).withColumn("code_id", F.lit(None).cast("string"))
        kind, new_codes = "eoa" if here.isEmpty() else "contract", here.limit(0)
    else:
        answers = held(ingest.classified(get_code(row)), "answers")
        kind = answers.first()["kind"]
        if kind == "failed":
            store.sweep(batch)
            return kind
        stored = _stored(answers)
        here = held(codes.fingerprints(answers.filter("kind = 'contract'")), "here")
        new_codes = here.join(store.codes(here.select("code_id")).select("code_id"), "code_id", "left_anti")
    if not here.filter("std_proxy").isEmpty() and store.implementations([address]).isEmpty():
        targets = row.select("address", "block")
        words, _ = _words(targets, get_slot, None, Limits(), held)
        resolved = held(ingest.resolved(targets, words, ("address", "block")).filter("implementation IS NOT NULL"), "resolved")
        named = resolved.filter("direct").select(F.col("implementation").alias("address"), "block", F.lit("impl").alias("origin"))
        named = named.join(store.known(named.select("address")).select("address"), "address", "left_anti")
        side = held(ingest.classified(get_code(named)), "side")
        more = held(codes.fingerprints(side.filter("kind = 'contract'")), "more")
        more = more.join(store.codes(more.select("code_id")).select("code_id"), "code_id", "left_anti").join(new_codes.select("code_id"), "code_id", "left_anti")
        stored, new_codes = stored.unionByName(_stored(side)), new_codes.unionByName(more, allowMissingColumns=True)
        store.write("implementations", resolved.withColumn("step", F.lit(store.step())), batch)
    store.write("codes", new_codes, batch)
    store.write("addresses", stored, batch)
    store.commit(batch, named=False)
    store.sweep(batch)
    return kind
