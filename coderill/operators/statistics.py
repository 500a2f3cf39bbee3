"""Descriptive statistics of the store: shares, distributions and rank correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lower edges of the histogram buckets; the last bucket is open.
SIZE_EDGES = (0, 256, 1024, 4096, 8192, 16384, 24576)
SELECTOR_EDGES = (0, 1, 2, 4, 8, 16, 32, 64)
CLUSTER_EDGES = (2, 3, 4, 5, 9, 17, 33, 65)
ORIGINS = ("created", "seen", "impl", "fetched", "unknown")
FEATURES = ("size", "opcode_count", "selector_count", "address_count", "l1_family_size", "is_proxy")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def counts(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: addresses, with_code, without_code, codes, blocks."""
    a = stored.agg(
        F.count(F.lit(1)).alias("addresses"),
        F.count("code_id").alias("with_code"),
        F.count_if(F.col("code_id").isNull()).alias("without_code"),
        F.countDistinct("block").alias("blocks"),
    )
    return a.crossJoin(codes.agg(F.count(F.lit(1)).alias("codes")))  # one row each


def origin_counts(stored: DataFrame, since_block: int | None = None) -> DataFrame:
    rows = stored if since_block is None else stored.filter(F.col("block") >= since_block)
    return rows.groupBy(F.coalesce("origin", F.lit("unknown")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(values: DataFrame, column: str, edges: tuple[int, ...]) -> DataFrame:
    """(edge, n) for every edge: values from it on and below the next; those below all edges are in the first."""
    at = F.greatest(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(column))), F.lit(1))
    found = values.filter(F.col(column).isNotNull()).groupBy(F.element_at(F.array(*map(F.lit, edges)), at).cast("long").alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.createDataFrame([(e,) for e in edges], "edge long")
    return every.join(found, "edge", "left").select("edge", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(values: DataFrame, column: str) -> DataFrame:
    """One row: least, exact median and greatest; zeros of nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return values.agg(
        zero(F.min(column)).cast("long").alias("min"),
        F.coalesce(F.median(column), F.lit(0.0)).alias("median"),
        zero(F.max(column)).cast("long").alias("max"),
    )


def levels(clusters: DataFrame, stored: DataFrame) -> DataFrame:
    """(level, clusters, addresses, share) of L0, L1, proxy and eip7702, of all addresses with code."""
    return levels_of(clusters, stored.agg(F.count("code_id").alias("whole")))


def levels_of(clusters: DataFrame, whole: DataFrame) -> DataFrame:
    """The same with the number of addresses with code as one row (whole)."""
    base = clusters.filter("level <> 'impl'")
    n = base.groupBy("level").agg(F.count(F.lit(1)).alias("clusters"), F.sum("n_members").alias("addresses"))  # an address is in one of a level
    every = clusters.sparkSession.createDataFrame([(x,) for x in ("L0", "L1", "proxy", "eip7702")], "level string")
    joined = every.join(n, "level", "left").crossJoin(whole)  # four rows and one
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("level", zero("clusters").alias("clusters"), zero("addresses").alias("addresses"), share(zero("addresses"), F.col("whole")).alias("share"))


def skeletons(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: codes that are no delegation, those of a skeleton of their own, and the addresses of both."""
    per_code = stored.groupBy("code_id").agg(F.count(F.lit(1)).alias("n"))
    plain = codes.filter("proxy_kind IS NULL").join(per_code, "code_id", "left").select("skeleton_hash", F.coalesce("n", F.lit(0)).alias("n"))
    families = plain.groupBy("skeleton_hash").agg(F.count(F.lit(1)).alias("codes"), F.sum("n").alias("addresses"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = families.agg(
        zero(F.sum("codes")).alias("codes"),
        zero(F.sum(F.when(F.col("codes") == 1, 1))).alias("unique_codes"),
        zero(F.sum("addresses")).alias("addresses"),
        zero(F.sum(F.when(F.col("codes") == 1, F.col("addresses")))).alias("unique_addresses"),
    )
    return out.withColumns({"code_share": share(F.col("unique_codes"), F.col("codes")), "address_share": share(F.col("unique_addresses"), F.col("addresses"))})


def risk(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """(flag, codes, addresses, code_share, address_share)."""
    flagged = codes.select("code_id", F.explode(F.array(F.when(F.col("selfdestruct"), "selfdestruct"), F.when(F.col("mutable_delegatecall"), "mutable_delegatecall"))).alias("flag")).filter("flag IS NOT NULL")
    n = flagged.groupBy("flag").agg(F.count(F.lit(1)).alias("codes"))
    a = stored.join(flagged, "code_id").groupBy("flag").agg(F.count(F.lit(1)).alias("addresses"))
    every = codes.sparkSession.createDataFrame([("selfdestruct",), ("mutable_delegatecall",)], "flag string")
    wholes = codes.agg(F.count(F.lit(1)).alias("all_codes")).crossJoin(stored.agg(F.count("code_id").alias("all_addresses")))
    joined = every.join(n, "flag", "left").join(a, "flag", "left").crossJoin(wholes)  # two rows and one
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "flag", zero("codes").alias("codes"), zero("addresses").alias("addresses"),
        share(zero("codes"), F.col("all_codes")).alias("code_share"), share(zero("addresses"), F.col("all_addresses")).alias("address_share"),
    )


def flagged_addresses(stored: DataFrame, codes: DataFrame, flag: str | None = None) -> DataFrame:
    """(address, flags) of addresses with a flag, or with the given one."""
    from coderill.functions.bytecode import flags

    rows = codes.select("code_id", flags(F.col("selfdestruct"), F.col("mutable_delegatecall")).alias("flags"))
    rows = rows.filter("flags <> '-'") if flag is None else rows.filter(F.array_contains(F.split("flags", ","), flag))
    return stored.join(rows, "code_id").select("address", "flags").orderBy("address")


def features(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """A row of FEATURES for each code; ``opcode_count``, made at ingest, is that of the whole code, trailer included."""
    per_code = stored.groupBy("code_id").agg(F.count(F.lit(1)).alias("address_count"))
    family = codes.groupBy("skeleton_hash").agg(F.count(F.lit(1)).alias("l1_family_size"))
    rows = codes.select("code_id", "skeleton_hash", "size", "opcode_count", F.size("selectors").cast("long").alias("selector_count"), F.col("proxy_kind").isNotNull().cast("long").alias("is_proxy"))
    joined = rows.join(per_code, "code_id", "left").join(family, "skeleton_hash")
    return joined.select(F.coalesce("address_count", F.lit(0)).alias("address_count"), *(c for c in FEATURES if c != "address_count"))


#: Distinct values of a feature that are ranked together, and broadcast, at most.
MOST_VALUES = 1_000_000


def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """(column, rank): ranks from 1 of distinct values with their number ``n``, ties sharing their mean.

    Values are dealt by ranges, and a range starts where the counts of those below it end, so that no task holds all of them.
    """
    dealt = values.repartitionByRange(F.col(column)).withColumn("part", F.spark_partition_id())
    starts = dealt.groupBy("part").agg(F.sum("n").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = starts.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("below", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), "part")
    return placed.select(column, (F.col("start") + F.col("below") + (F.col("n") + 1) / 2).alias(f"{column}_rank"))


def _all_ranks(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame | None:
    """(feature, value, rank) of all features in one pass, where each has few distinct values; else none."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("value")) for c in columns)))
    counts = rows.select(pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count(F.lit(1)).alias("n")).persist()
    if counts.count() > MOST_VALUES:
        counts.unpersist()
        return None
    below = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("feature", "value", (F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(a, b, rho): Pearson's coefficient of average ranks; null where a feature does not vary."""
    rows = rows.select(*columns).persist()
    ranks = _all_ranks(rows, columns)
    ranked = rows
    for c in columns:
        if ranks is not None:
            one = F.broadcast(ranks.filter(F.col("feature") == c).select(F.col("value").alias(c), F.col("rank").alias(f"{c}_rank")))
        else:
            one = average_ranks(rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c)
        ranked = ranked.join(one, c)
    aggs = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            x, y = F.col(f"{a}_rank"), F.col(f"{b}_rank")
            aggs.append(F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))).alias(f"{a}|{b}"))
    wide = ranked.agg(*aggs)
    pairs = [(a, b) for a in columns for b in columns]
    index = {c: i for i, c in enumerate(columns)}
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{'|'.join(sorted((a, b), key=index.get))}`").alias("rho")) for a, b in pairs]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def origin_shares(counts: DataFrame) -> DataFrame:
    """(origin, count, percent) of the five origins, in percent with one decimal, of which half is rounded up; zeros of nothing."""
    every = counts.sparkSession.createDataFrame([(o,) for o in ORIGINS], "origin string")
    joined = every.join(counts, "origin", "left").select("origin", F.coalesce("n", F.lit(0)).alias("count"))
    whole = joined.agg(F.sum("count").alias("whole"))
    percent = F.floor(F.try_divide(F.col("count") * 1000.0, F.col("whole")) + 0.5) / 10
    return joined.crossJoin(whole).select("origin", "count", F.coalesce(percent, F.lit(0.0)).alias("percent"))  # five rows and one


def alerts_by_seed(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("seed_address", "label").agg(F.count(F.lit(1)).alias("n"))
