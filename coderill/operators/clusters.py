"""Clusters of addresses: same code, same template, same delegation target, same implementation.

Sizes are made from counts of addresses by code, so that members are gathered only of the clusters that are asked for. A
cluster's list of members is as long as the cluster, as those who ask want it; sizes have no such list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("L0", "L1", "proxy", "eip7702", "impl")
FIELDS = ("code_id", "skeleton_hash", "proxy_kind", "proxy_target", "std_proxy")


def _target() -> Column:
    return F.concat_ws(":", "proxy_kind", "proxy_target")


def sizes(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """(level, key, n_members) of clusters of two members or more; ``stored`` has a row for each address."""
    n = F.count(F.lit(1))
    per_code = stored.filter("code_id IS NOT NULL").groupBy("code_id").agg(n.alias("n"))
    behind = stored.filter("implementation IS NOT NULL").groupBy("implementation", "code_id").agg(n.alias("n"))
    return sizes_from(per_code, behind, codes)


def sizes_from(per_code: DataFrame, behind: DataFrame, codes: DataFrame) -> DataFrame:
    """The same from numbers of addresses: (code_id, n), and (implementation, code_id, n)."""
    n = F.count(F.lit(1))
    held = per_code.join(codes.select(*FIELDS), "code_id")
    plain = held.filter("proxy_kind IS NULL")
    total = F.sum("n").alias("n_members")
    parts = {
        "L0": plain.select(F.col("code_id").alias("key"), F.col("n").alias("n_members")),
        "L1": plain.groupBy(F.col("skeleton_hash").alias("key")).agg(total, n.alias("codes")).filter("codes >= 2").drop("codes"),
        "proxy": held.filter("proxy_kind = 'eip1167'").groupBy(_target().alias("key")).agg(total),
        "eip7702": held.filter("proxy_kind = 'eip7702'").groupBy(_target().alias("key")).agg(total),
        "impl": behind.join(codes.filter("std_proxy").select("code_id"), "code_id", "left_semi").groupBy(F.col("implementation").alias("key")).agg(total),
    }
    return reduce(DataFrame.unionByName, (rows.filter("n_members >= 2").select(F.lit(level).alias("level"), "key", "n_members") for level, rows in parts.items()))


def codes_of(chosen: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes whose holders are members of some clusters (level, key), but for those by implementation."""
    keys = chosen.select("level", "key").distinct()
    by = {"L0": F.col("code_id"), "L1": F.col("skeleton_hash"), "proxy": _target(), "eip7702": _target()}
    kinds = {"L0": "proxy_kind IS NULL", "L1": "proxy_kind IS NULL", "proxy": "proxy_kind = 'eip1167'", "eip7702": "proxy_kind = 'eip7702'"}
    parts = (codes.filter(kinds[level]).withColumn("key", key).join(keys.filter(F.col("level") == level).select("key"), "key", "left_semi").drop("key") for level, key in by.items())
    return reduce(DataFrame.unionByName, parts).distinct()


def _memberships(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """(address, level, key) for each cluster that an address would be in, whatever its size."""
    held = stored.filter("code_id IS NOT NULL").join(codes.select(*FIELDS), "code_id")
    plain = F.col("proxy_kind").isNull()
    one = lambda level, when, key: F.when(when, F.struct(F.lit(level).alias("level"), key.alias("key")))
    of = F.array_compact(
        F.array(
            one("L0", plain, F.col("code_id")), one("L1", plain, F.col("skeleton_hash")), one("proxy", F.col("proxy_kind") == "eip1167", _target()),
            one("eip7702", F.col("proxy_kind") == "eip7702", _target()), one("impl", F.col("std_proxy") & F.col("implementation").isNotNull(), F.col("implementation")),
        )
    )
    return held.select("address", F.explode(of).alias("c")).select("address", "c.level", "c.key")


def members(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """(level, key, address) of all clusters, a row for each member."""
    return _memberships(stored, codes).join(sizes(stored, codes).select("level", "key"), ["level", "key"], "left_semi")


def with_members(chosen: DataFrame, stored: DataFrame, codes: DataFrame) -> DataFrame:
    """Some clusters (level, key, n_members) with the sorted ``members`` of each."""
    rows = _memberships(stored, codes).join(chosen, ["level", "key"])
    found = rows.groupBy("level", "key", "n_members").agg(F.array_sort(F.collect_set("address")).alias("members"))
    return found.select("level", "key", "members", "n_members")


def build(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """(level, key, members, n_members) of all clusters."""
    return with_members(sizes(stored, codes), stored, codes)


def rank(level: str = "level") -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), F.col(level))


def top(clusters: DataFrame, n: int = 20, level: str | None = None) -> DataFrame:
    """Largest clusters first, then by level and key."""
    if n < 1:
        raise ValueError("n is 1 or more")
    rows = clusters if level is None else clusters.filter(F.col("level") == level)
    return rows.orderBy(F.desc("n_members"), rank(), "key").limit(n)


def containing(stored: DataFrame, codes: DataFrame, address: str) -> DataFrame:
    """The clusters of one address with their members, largest first."""
    own = stored.filter(F.col("address") == address.lower())
    mine = own.join(codes.select(*FIELDS), "code_id")
    keys = F.array(F.col("code_id"), F.col("skeleton_hash"), _target(), F.col("implementation"))
    found = sizes(stored, codes).join(mine.select(F.explode(keys).alias("key")).filter("key IS NOT NULL").distinct(), "key", "left_semi")
    out = with_members(found.select("level", "key", "n_members"), stored, codes).filter(F.array_contains("members", address.lower()))
    return out.orderBy(F.desc("n_members"), rank(), "key")
