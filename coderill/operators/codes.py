"""Codes and addresses of the store, from contracts as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.functions import bytecode as B


def fingerprints(raw: DataFrame) -> DataFrame:
    """One row for each distinct non-empty code of ``hx``: its fingerprint, with ``hx``, opcodes and opcode runs.

    Instructions are made once, before the columns that use them; the code's text stays a column of its
    own, so that readers of fingerprints do not read it.
    """
    one = raw.select("hx").filter("hx <> ''").distinct()
    # exploding an array of one keeps later columns and filters above it, so that nothing is made twice
    split = one.select("hx", F.explode(F.array(B.tokens(B.body(F.col("hx"))))).alias("tok"))
    out = split.select("hx", F.explode(F.array(F.struct(*B.fingerprint(F.col("hx"))))).alias("f")).select("hx", "f.*")
    out = out.select("*", F.explode(F.array(B.numbered(F.col("ops")))).alias("numbers")).withColumn("runs", B.shingles(F.col("numbers"))).drop("numbers")
    # instructions of the whole code, where the last push of the body may take bytes of the trailer
    whole = F.when(B.body_chars(F.col("hx")) == F.length("hx"), F.size("ops")).otherwise(F.size(B.tokens(F.col("hx"))))
    out = out.withColumn("opcode_count", whole.cast("long"))
    return out.withColumn("selfdestruct", B.selfdestructs(F.col("ops"))).withColumn(
        "mutable_delegatecall", B.mutable_delegatecall(F.col("ops"), F.col("proxy_kind"), F.col("std_proxy"))
    )


def scored(raw: DataFrame) -> DataFrame:
    """Of ``fingerprints`` what scores by selectors need: (code_id, proxy_kind, proxy_target, std_proxy, selectors)."""
    one = raw.select("hx").filter("hx <> ''").distinct()
    hx, tok = F.col("hx"), F.col("tok")
    split = one.select("hx", F.explode(F.array(B.tokens(B.body(hx)))).alias("tok"))
    fields = B.proxy_kind(hx).alias("proxy_kind"), B.proxy_target(hx).alias("proxy_target"), B.is_standard_proxy(tok).alias("std_proxy"), B.selectors(tok).alias("selectors")
    return split.select(F.sha2(F.unhex(hx), 256).alias("code_id"), *fields)


def addresses(contracts: DataFrame) -> DataFrame:
    """(address, code_id, block, origin, implementation): first record of an address, lower case; no code, null id."""
    code = F.when(F.col("hx") != "", F.sha2(F.unhex("hx"), 256)).alias("code_id")
    rows = contracts.select(F.lower("address").alias("address"), code, "block", "origin", F.lower("implementation").alias("implementation"))
    first = F.min_by(F.struct("code_id", "block", "origin", "implementation"), F.struct("block", F.coalesce("origin", F.lit("")), F.coalesce("code_id", F.lit(""))))
    return rows.groupBy("address").agg(first.alias("r")).select("address", "r.*")


def implementations(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """(address, implementation, impl_code_id) of standard proxies; the last is null where the target has no stored code."""
    proxies = stored.join(codes.filter("std_proxy").select("code_id"), "code_id").select("address", "implementation")
    targets = stored.select(F.col("address").alias("implementation"), F.col("code_id").alias("impl_code_id"))
    return proxies.join(targets, "implementation", "left").select("address", "implementation", "impl_code_id")


def effective(stored: DataFrame, codes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(address, code_id): the code that an address is scored by, one hop through a resolved standard proxy; ``known`` are the ``implementations``, where they are made."""
    impl = (implementations(stored, codes) if known is None else known).select("address", "impl_code_id")
    joined = stored.filter("code_id IS NOT NULL").join(impl, "address", "left")
    return joined.select("address", F.coalesce("impl_code_id", "code_id").alias("code_id"))


def seeds(rows: DataFrame, stored: DataFrame, codes: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """(address, code_id, label, strict): seeds with the code that counts when they are added; without code, none."""
    plain = rows.select(F.lower("address").alias("address"), "label", "strict")
    return plain.join(effective(stored, codes) if scored is None else scored, "address").select("address", "code_id", "label", F.coalesce("strict", F.lit(False)).alias("strict"))
