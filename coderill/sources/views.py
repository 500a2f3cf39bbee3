"""Counts of a store, kept by differences: a batch adds what it changes, and reading sums what batches added.

A tally is (kind, key, code_id, block, n): ``origin`` counts addresses by origin and block, ``code`` by code, and ``impl`` by
implementation and own code. A batch that brings an earlier record of an address, or another implementation, takes its
old tallies away with a negative number. Batches read of addresses and implementations only what they touch, and
merges add tallies up, so counts of any number of batches are as many rows as there are keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coderill.operators import clusters, statistics
from coderill.sources.store import MERGES, Store


def _tallies(addresses: DataFrame, implementations: DataFrame, sign: int) -> DataFrame:
    """Of one row for each address, and at most one implementation."""
    none = F.lit(None).cast("string")
    held = addresses.join(implementations.select("address", "implementation"), "address", "left")
    row = lambda kind, key, code, block: F.struct(F.lit(kind).alias("kind"), key.alias("key"), code.alias("code_id"), block.alias("block"))
    of = F.array(
        row("origin", F.coalesce("origin", F.lit("unknown")), none, F.col("block")),
        row("code", F.col("code_id"), F.col("code_id"), F.lit(None).cast("long")),
        row("impl", F.col("implementation"), F.col("code_id"), F.lit(None).cast("long")),
    )
    return held.select(F.explode(of).alias("t")).select("t.*", F.lit(sign).cast("long").alias("n")).filter("key IS NOT NULL")


def differences(store: Store, addresses: DataFrame, implementations: DataFrame, anew: bool = False) -> DataFrame:
    """Tallies that rows of both tables add to those of the store's committed rows, or with ``anew`` to none."""
    touched = [] if anew else store.keys(addresses.select("address").unionByName(implementations.select("address")))
    before = {"addresses": addresses, "implementations": implementations}
    before = {name: store.among(name, touched) if not anew else rows.limit(0) for name, rows in before.items()}
    after = {"addresses": before["addresses"].unionByName(addresses), "implementations": before["implementations"].unionByName(implementations)}
    sides = [_tallies(*(MERGES[name](side[name]) for name in side), sign) for side, sign in ((before, -1), (after, 1))]
    return MERGES["tallies"](reduce(DataFrame.unionByName, sides))


def tallies(store: Store, kind: str) -> DataFrame:
    return MERGES["tallies"](store.read("tallies").filter(F.col("kind") == kind))


def per_code(store: Store) -> DataFrame:
    """(code_id, n)."""
    return tallies(store, "code").select("code_id", "n")


def sizes(store: Store) -> DataFrame:
    """(level, key, n_members) of clusters of two members or more, without reading addresses."""
    behind = tallies(store, "impl").select(F.col("key").alias("implementation"), "code_id", "n")
    return clusters.sizes_from(per_code(store), behind, store.codes())


def origin_counts(store: Store, since_block: int | None = None) -> DataFrame:
    rows = tallies(store, "origin")
    rows = rows if since_block is None else rows.filter(F.col("block") >= since_block)
    return rows.groupBy(F.col("key").alias("origin")).agg(F.sum("n").alias("n")).filter("n <> 0")


def counts(store: Store) -> DataFrame:
    """One row: addresses, with_code, without_code, codes, blocks."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = tallies(store, "origin").groupBy("block").agg(F.sum("n").alias("n")).filter("n <> 0")
    a = blocks.agg(zero(F.sum("n")).alias("addresses"), F.count("block").alias("blocks"))
    b = per_code(store).agg(zero(F.sum("n")).alias("with_code"))
    c = store.codes().agg(F.count(F.lit(1)).alias("codes"))
    rows = a.crossJoin(b).crossJoin(c)  # one row each
    return rows.select("addresses", "with_code", (F.col("addresses") - F.col("with_code")).alias("without_code"), "blocks", "codes")


def levels(store: Store) -> DataFrame:
    """(level, clusters, addresses, share) as ``statistics.levels`` has it."""
    whole = per_code(store).agg(F.sum("n").alias("whole"))
    return statistics.levels_of(sizes(store), whole)


def resolved(store: Store) -> int:
    """Addresses with an implementation."""
    return tallies(store, "impl").agg(F.sum("n")).first()[0] or 0


def members(store: Store, chosen: DataFrame) -> DataFrame:
    """Some clusters (level, key, n_members) with their sorted members, of which only the holders of their codes are read."""
    codes = store.codes().select("code_id", *(c for c in clusters.FIELDS if c != "code_id"))
    wanted = clusters.codes_of(chosen, codes)
    proxies = store.read("implementations").join(chosen.filter("level = 'impl'").select(F.col("key").alias("implementation")).distinct(), "implementation", "left_semi").select("address")
    rows = store.holders_of(wanted.select("code_id")).select("address").unionByName(proxies).distinct()
    return clusters.with_members(chosen, store.addresses(rows), codes)


def pages(members: DataFrame, size: int = 10_000) -> DataFrame:
    """(level, key, page, members) of rows (level, key, address): sorted members in lists of ``size`` at most.

    A cluster's members are ranked in ranges of addresses, so that no task holds a whole cluster.
    """
    ranged = members.withColumn("range", F.substring("address", 1, 5))
    starts = ranged.groupBy("level", "key", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("level", "key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("level", "key", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("level", "key", "range").orderBy("address")
    ranked = ranged.withColumn("k", F.row_number().over(within) - 1).join(starts, ["level", "key", "range"])
    page = F.floor((F.col("start") + F.col("k")) / size).cast("long")
    return ranked.groupBy("level", "key", page.alias("page")).agg(F.array_sort(F.collect_list("address")).alias("members"))
