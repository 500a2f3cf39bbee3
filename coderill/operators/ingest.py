"""Steps of a block's ingest as DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coderill.functions.bytecode import is_hex_code, slot_address
from coderill.operators.similarity import CLASS, to_members

#: A receipt as far as it is read; anything else in it is ignored.
RECEIPT = "struct<contractAddress:string,to:string,logs:array<struct<address:string>>>"


def touched(receipts: DataFrame) -> DataFrame:
    """(block, address, created) of receipts (block, receipt as JSON text); what is no object counts for nothing."""
    parsed = receipts.select("block", F.from_json("receipt", RECEIPT).alias("r"))
    created = F.array(F.struct(F.col("r.contractAddress").alias("address"), F.lit(True).alias("created")))
    seen = F.concat(F.array(F.col("r.to")), F.coalesce(F.transform("r.logs", lambda x: x["address"]), F.array().cast("array<string>")))
    rows = parsed.select("block", F.explode(F.concat(created, F.transform(seen, lambda a: F.struct(a.alias("address"), F.lit(False).alias("created"))))).alias("t"))
    return rows.select("block", "t.address", "t.created").filter("address IS NOT NULL")


def candidates(rows: DataFrame) -> DataFrame:
    """(block, address, origin): each address of a block once, created if any of its receipts creates it."""
    grouped = rows.groupBy("block", F.lower("address").alias("address")).agg(F.max("created").alias("created"))
    return grouped.select("block", "address", F.when(F.col("created"), "created").otherwise("seen").alias("origin"))


def unknown(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.join(stored.select("address"), "address", "left_anti")


def first_seen(found: DataFrame) -> DataFrame:
    """(address, block, origin): over many blocks, the first record of an address."""
    first = F.min_by(F.struct("block", "origin"), F.col("block"))
    return found.groupBy("address").agg(first.alias("r")).select("address", "r.block", "r.origin")


def capped(new: DataFrame, most: int | None, calls: int | None = None) -> DataFrame:
    """New candidates with ``fetched``: the first ``most`` of each block in order of address, and ``calls`` in all, in order of block."""
    order = Window.partitionBy("block").orderBy("address")
    ranked = new.withColumn("k", F.row_number().over(order))
    allowed = F.lit(most) if most is not None else F.lit(1 << 60)
    if calls is None:
        return ranked.withColumn("fetched", F.col("k") <= allowed).drop("k")
    per_block = new.groupBy("block").agg(F.least(F.count(F.lit(1)), allowed).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    left = F.lit(calls) - F.coalesce(F.sum("n").over(before), F.lit(0))
    quota = per_block.select("block", F.greatest(F.least("n", left), F.lit(0)).alias("quota"))
    return ranked.join(quota, "block").withColumn("fetched", F.col("k") <= F.col("quota")).select(*new.columns, "fetched")


def reserved(reads: DataFrame, left: int | None, price: int) -> DataFrame:
    """The first reads (address, block), in order of block and address, whose prices sum up to ``left`` credits at most."""
    if left is None or price <= 0:
        return reads
    return capped(reads, None, max(0, left) // price).filter("fetched").drop("fetched")


def classified(answers: DataFrame) -> DataFrame:
    """Answers (block, address, origin, answer) with ``kind``: contract, eoa, or failed for what is no code."""
    code = F.col("answer")
    kind = F.when(code.isNull() | ~is_hex_code(code), "failed").when(code == "0x", "eoa").otherwise("contract")
    return answers.withColumn("kind", kind).withColumn("hx", F.when(F.col("kind") == "contract", F.lower(F.substring("answer", 3, 2_000_000_000))).otherwise(F.lit("")))


def block_stats(found: DataFrame, known: DataFrame, decided: DataFrame, kinds: DataFrame) -> DataFrame:
    """(block, candidates, known, fetched, deferred, contracts, eoas, failed, complete)."""
    n = F.count(F.lit(1))
    parts = [
        found.groupBy("block").agg(n.alias("candidates")),
        found.join(known.select("address"), "address", "left_semi").groupBy("block").agg(n.alias("known")),
        decided.groupBy("block").agg(F.count_if("fetched").alias("fetched"), F.count_if(~F.col("fetched")).alias("deferred")),
        kinds.groupBy("block").agg(*(F.count_if(F.col("kind") == k).alias(c) for k, c in (("contract", "contracts"), ("eoa", "eoas"), ("failed", "failed")))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "block", "left")
    out = out.na.fill(0)
    return out.withColumn("complete", F.col("deferred") == 0)


def resolved(proxies: DataFrame, slots: DataFrame, by: tuple[str, ...] = ("address",)) -> DataFrame:
    """(address, implementation, direct): of the implementation slot (direct), else of the beacon slot if the first read did not fail.

    ``slots`` is (address, slot, word), with a null word for a failed read; ``by`` may add the block to both.
    """
    impl = slots.filter("slot = 'implementation'").select(*by, F.col("word").alias("impl_word"))
    beacon = slots.filter("slot = 'beacon'").select(*by, F.col("word").alias("beacon_word"))
    joined = proxies.select(*by).join(impl, list(by), "left").join(beacon, list(by), "left")
    own = slot_address(F.col("impl_word"))
    other = F.when(F.col("impl_word").isNotNull(), slot_address(F.col("beacon_word")))
    return joined.select(*by, F.coalesce(own, other).alias("implementation"), own.isNotNull().alias("direct"))


def changes(found: DataFrame, before: DataFrame) -> DataFrame:
    """(block, address, old_impl, new_impl) of resolved proxies (block, address, implementation), block after block.

    ``before`` is (address, implementation) as known so far. A first implementation is no change, and a failed read leaves what is known.
    """
    rows = found.filter("implementation IS NOT NULL").join(before.select("address", F.col("implementation").alias("known")), "address", "left")
    earlier = F.lag("implementation").over(Window.partitionBy("address").orderBy("block"))
    rows = rows.select("block", "address", F.coalesce(earlier, "known").alias("old_impl"), F.col("implementation").alias("new_impl"))
    return rows.filter("old_impl IS NOT NULL AND old_impl <> new_impl")


def upgrades(before: DataFrame, now: DataFrame) -> DataFrame:
    """(address, old_impl, new_impl): a known implementation that another one follows; a failed read changes nothing."""
    joined = before.select("address", F.col("implementation").alias("old_impl")).join(now.select("address", F.col("implementation").alias("new_impl")), "address")
    return joined.filter("old_impl IS NOT NULL AND new_impl IS NOT NULL AND new_impl <> old_impl")


def overlaid(before: DataFrame, now: DataFrame) -> DataFrame:
    """Known implementations with the new ones over them; what was not resolved stays."""
    fresh = now.select("address", F.col("implementation").alias("new_impl"))
    return before.join(fresh, "address", "left").withColumn("implementation", F.coalesce("new_impl", "implementation")).drop("new_impl")


KINDS = ("ALERT", "UPGRADE")


def _alert_rows(alerts: DataFrame, *kept: str) -> DataFrame:
    none = F.lit(None)
    return alerts.select(
        *kept,
        F.lit(KINDS[0]).alias("kind"), "block", F.lower("address").alias("address"), F.lower("seed_address").alias("seed_address"), "label", "score", "origin",
        none.cast("string").alias("old_impl"), none.cast("string").alias("new_impl"),
    )


def _change_rows(changes: DataFrame) -> DataFrame:
    none = F.lit(None)
    return changes.select(
        F.lit(KINDS[1]).alias("kind"), "block", F.lower("address").alias("address"), none.cast("string").alias("seed_address"), none.cast("string").alias("label"),
        none.cast("double").alias("score"), none.cast("string").alias("origin"), F.lower("old_impl").alias("old_impl"), F.lower("new_impl").alias("new_impl"),
    )


def _firsts(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """(block, alerts, first) from numbers (block, n) of alerts and of changes: how many ids come before those of a block."""
    none = F.lit(0).cast("long")
    counts = alerts.select("block", F.col("n").alias("alerts"), none.alias("changes")).unionByName(changes.select("block", none.alias("alerts"), F.col("n").alias("changes")))
    per_block = counts.groupBy("block").agg(F.sum("alerts").alias("alerts"), F.sum("changes").alias("changes"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    return per_block.select("block", "alerts", F.coalesce(F.sum(F.col("alerts") + F.col("changes")).over(before), F.lit(0)).alias("first"))


def events(alerts: DataFrame, changes: DataFrame, start: int = 0) -> DataFrame:
    """Event rows with ids in order: by block, alerts before upgrades, then as they come in their lists.

    The kinds are numbered apart, after counts by block, so that who reads one kind does not order the rows of the other.
    """
    n = F.count(F.lit(1)).alias("n")
    firsts = _firsts(alerts.groupBy("block").agg(n), changes.groupBy("block").agg(n))
    within = Window.partitionBy("block").orderBy("address", F.desc("score"), "seed_address", "new_impl")

    def numbered(rows: DataFrame, first: Column) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(within)).join(firsts, "block").select((F.lit(start) + first + F.col("k")).alias("id"), *rows.columns)

    return numbered(_alert_rows(alerts), F.col("first")).unionByName(numbered(_change_rows(changes), F.col("first") + F.col("alerts")))


def events_of_classes(rows: DataFrame, found: DataFrame, changes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda frame, name: frame, start: int = 0) -> DataFrame:
    """The same events where alerts follow from classes: every one of ``members`` has the alerts that were ``found`` for its class, but not itself.

    The alerts of a class are numbered once. An address knows by how many there are where its own begin in their block, so no alert is sorted, and
    none is made for who reads changes only. Seeds of one address have one score for a class, so they are neighbours in its order.
    """
    n, ids = F.count(F.lit(1)).alias("n"), list(CLASS)
    ranked = keep(found.withColumn("k", F.row_number().over(Window.partitionBy(*CLASS).orderBy(F.desc("score"), "seed_address", "label"))), "ranked")
    itself = ranked.groupBy(*CLASS, F.col("seed_address").alias("address")).agg(F.min("k").alias("own"), F.count(F.lit(1)).alias("n_own"))
    held = rows.join(ranked.groupBy(*CLASS).agg(n), ids).join(itself, [*CLASS, "address"], "left")
    held = keep(held.withColumn("n", F.col("n") - F.coalesce("n_own", F.lit(0))).filter("n > 0"), "held")
    firsts = keep(_firsts(held.groupBy("block").agg(F.sum("n").alias("n")), changes.groupBy("block").agg(n)), "firsts")
    earlier = F.sum("n").over(Window.partitionBy("block").orderBy("address").rowsBetween(Window.unboundedPreceding, -1))
    placed = held.withColumn("at", F.coalesce(earlier, F.lit(0))).join(firsts, "block")
    passed = F.when(F.col("k") > F.col("own"), F.col("n_own")).otherwise(F.lit(0))
    alerts = to_members(placed, ranked).withColumn("id", F.lit(start) + F.col("first") + F.col("at") + F.col("k") - passed)
    changed = _change_rows(changes)
    k = F.row_number().over(Window.partitionBy("block").orderBy("address", "new_impl"))
    numbered = changed.withColumn("k", k).join(firsts, "block").select((F.lit(start) + F.col("first") + F.col("alerts") + F.col("k")).alias("id"), *changed.columns)
    return _alert_rows(alerts, "id").unionByName(numbered)


def lines(rows: DataFrame, alert_on: str = "all") -> DataFrame:
    """(id, line) of events as they are printed; ``alert_on`` shows alerts of one origin only, and hides no upgrade."""
    alert = F.concat_ws("\t", F.lit("ALERT"), "address", "seed_address", "label", F.format_string("%.4f", "score"), "origin")
    upgrade = F.concat_ws("\t", F.lit("UPGRADE"), "address", "old_impl", "new_impl", F.col("block").cast("string"))
    shown = rows if alert_on == "all" else rows.filter((F.col("kind") == "UPGRADE") | (F.col("origin") == alert_on))
    return shown.select("id", F.when(F.col("kind") == "ALERT", alert).otherwise(upgrade).alias("line"))


def ledger_days(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("day").agg(F.sum("credits").alias("credits")).orderBy("day")


def events_after(rows: DataFrame, after: int, limit: int) -> DataFrame:
    """The newest ``limit`` events with a greater id, newest first."""
    return rows.filter(F.col("id") > after).orderBy(F.desc("id")).limit(limit)


def seed_counts(rows: DataFrame) -> DataFrame:
    """(seed_address, label, n) of alerts, most first."""
    return by_count(rows.filter("kind = 'ALERT'").groupBy("seed_address", "label").agg(F.count(F.lit(1)).alias("n")))


def by_count(found: DataFrame) -> DataFrame:
    """Numbers of alerts (seed_address, label, n), most first."""
    return found.orderBy(F.desc("n"), "label", "seed_address")


def of_kind(rows: DataFrame, kind: str = "ALL") -> DataFrame:
    return rows if kind == "ALL" else rows.filter(F.col("kind") == kind)


def merged(kept: DataFrame, incoming: DataFrame, most: int = 500) -> DataFrame:
    """A feed of events: each id once, as it is kept if it is in both, newest first."""
    fresh = incoming.dropDuplicates(["id"]).join(kept.select("id"), "id", "left_anti")
    return kept.dropDuplicates(["id"]).unionByName(fresh.select(*kept.columns)).orderBy(F.desc("id")).limit(most)


def event_counts(rows: DataFrame) -> DataFrame:
    """(kind, n), with zeros."""
    return _every_kind(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


def event_counts_of(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """The same from numbers of alerts (n) and from changes."""
    parts = ((KINDS[0], alerts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))), (KINDS[1], changes.agg(F.count(F.lit(1)).alias("n"))))
    return _every_kind(reduce(DataFrame.unionByName, (part.select(F.lit(kind).alias("kind"), "n") for kind, part in parts)))


def _every_kind(found: DataFrame) -> DataFrame:
    every = found.sparkSession.createDataFrame([(kind,) for kind in KINDS], "kind string")
    return every.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
