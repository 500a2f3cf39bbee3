"""A contract corpus derived from the star-schema tables, in SQL that Spark and DuckDB both read.

``part`` gives codes and contracts, ``supplier`` accounts without code, ``orders`` and ``lineitem`` the
receipts of blocks, ``documents`` raw bytes. Everything follows from keys by ``md5``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from coderill.functions.bytecode import BEACON_SLOT, CLONE_HEAD, CLONE_TAIL, DELEGATION_HEAD, IMPLEMENTATION_SLOT
from coderill.sources.shared import written

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def address(namespace: str, key: str) -> str:
    k = f"'{namespace}:' || CAST({key} AS STRING)"
    return f"'0x' || left(md5({k}) || md5({k} || '#'), 40)"


def _hex40(key: str) -> str:
    return f"left(md5({key}) || md5({key} || '#'), 40)"


_DISPATCH = " || ".join(f"CASE WHEN {i} < n THEN '8063' || left(md5(p_brand || ':{i}'), 8) || '146100ff57' ELSE '' END" for i in range(12))
_TRAILER = "'a165627a7a72305820' || md5('m' || k) || md5('n' || k) || '0029'"
_WORD = "lower(hex(p_name))"

#: A contract for each part: address, code as hexadecimal text (empty: no code), block, origin, implementation.
BUILT = f"""
keyed AS (
  SELECT *, CAST(p_partkey AS STRING) AS k, 3 + 3 * (p_size % 4) AS n, p_partkey % 20 AS kind FROM part),
built AS (
  SELECT p_partkey, k, kind, {address('part', 'p_partkey')} AS address,
    CASE kind
      WHEN 0 THEN '{CLONE_HEAD}' || {_hex40("'t' || CAST(p_partkey % 7 AS STRING)")} || '{CLONE_TAIL}'
      WHEN 1 THEN '{DELEGATION_HEAD}' || {_hex40("'t' || CAST(p_partkey % 5 AS STRING)")}
      WHEN 2 THEN '60806040527f{IMPLEMENTATION_SLOT}54f4' || {_TRAILER}
      WHEN 3 THEN '6080604052' || {_DISPATCH} || '00'
      WHEN 4 THEN '6080604052' || {_DISPATCH} || 'ff00' || {_TRAILER}
      WHEN 5 THEN '6080604052' || {_DISPATCH} || '6000545af400' || {_TRAILER}
      WHEN 6 THEN ''
      WHEN 7 THEN '6080604052' || {_DISPATCH} || '7f' || left(md5(k), 10)
      WHEN 8 THEN md5(k) || md5(k || 'x')
      WHEN 12 THEN '60806040527f{BEACON_SLOT}5450' || {_TRAILER}
      ELSE '6080604052' || {_DISPATCH} || '73' || {_hex40("'i' || k")} || '7f' || md5(k || 'y') || md5(k || 'z') || '00' || {_TRAILER}
    END AS hx,
    p_partkey // 10 + 1 AS block,
    CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'created' WHEN p_partkey % 7 = 0 THEN 'impl' ELSE 'seen' END AS origin,
    CASE WHEN kind IN (2, 12) AND p_partkey % 60 <> 2 THEN {address('part', '(p_partkey - p_partkey % 40) + 9')} END AS implementation
  FROM keyed)"""

#: Those, and accounts without code.
_CONTRACTS = f"""
contracts AS (
  SELECT address, hx, CAST(block AS BIGINT) AS block, origin, implementation FROM built
  UNION ALL
  SELECT {address('supplier', 's_suppkey')}, '', CAST(s_suppkey % 50 + 1 AS BIGINT), 'seen', NULL FROM supplier)"""

CONTRACTS = f"{BUILT},{_CONTRACTS}"

#: Seeds as the operator names them: an address, a label, and whether it is strict.
SEEDS = """
seed_rows AS (
  SELECT address, 'label-' || k AS label, p_partkey % 2 = 0 AS strict FROM built WHERE p_partkey % 97 = 0 AND hx <> '')"""

#: Candidates of blocks: contracts that receipts create, and addresses that they touch.
RECEIPTS = f"""
touched AS (
  SELECT CAST(o_custkey % 40 AS BIGINT) AS block, {address('part', 'o_orderkey % 4000')} AS address, TRUE AS created FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT CAST(o_custkey % 40 AS BIGINT), upper({address('customer', 'o_custkey')}), FALSE FROM orders
  UNION ALL SELECT CAST(l_orderkey % 40 AS BIGINT), {address('part', 'l_partkey')}, FALSE FROM lineitem)"""

_ORIGIN_COUNTS = """'{"created":' || k || ',"seen":2,"impl":0,"fetched":0,"unknown":1}'"""

#: JSON answers of the serving views as a client reads them, most of them with a fault: (p_partkey, what, answer).
ANSWERS = f"""
answers AS (
  SELECT p_partkey, what, CASE p_partkey % 13
      WHEN 0 THEN left(answer, length(answer) - 1) WHEN 1 THEN replace(answer, '"block":', '"blocks":') WHEN 2 THEN replace(answer, ':null', ':[]')
      WHEN 3 THEN replace(answer, '"UPGRADE"', '"OTHER"') WHEN 4 THEN replace(answer, '"members":["', '"members":["x",1,"') WHEN 5 THEN replace(answer, '"now":', '"now":1,"then":')
      WHEN 6 THEN replace(answer, '"seen":', '"seen":null,"gone":') WHEN 7 THEN replace(answer, '"n":', '"n":"1","m":') WHEN 8 THEN '[' || answer || ']'
      WHEN 9 THEN replace(answer, '"score":0.', '"score":"",,') WHEN 10 THEN replace(answer, '"count":', '"count":true,"of":') ELSE answer END AS answer
  FROM (
    SELECT p_partkey, 'health' AS what, '{{"progress":' || CASE WHEN kind < 3 THEN 'null' ELSE CAST(block AS STRING) END || ',"progress_at":' || coalesce('"' || origin || '"', 'null')
      || ',"seconds_since_progress":' || CASE WHEN kind < 5 THEN 'null' ELSE k || '.5' END || ',"now":"' || md5(k) || '"}}' AS answer FROM built
    UNION ALL SELECT p_partkey, 'events', '{{"events":[{{"id":' || k || '1,"kind":"ALERT","block":' || CAST(block AS STRING) || ',"at":"","address":"' || address || '","seed_address":"' || md5(k)
      || '","label":"l","origin":' || coalesce('"' || origin || '"', 'null') || ',"old_impl":null,"new_impl":null,"score":0.75}},{{"id":' || k || '0,"kind":"UPGRADE","block":' || CAST(block AS STRING)
      || ',"at":"","address":"' || address || '","seed_address":null,"label":null,"origin":null,"old_impl":' || coalesce('"' || implementation || '"', 'null')
      || ',"new_impl":"' || md5(k) || '","score":null}}],"last_id":' || k || '1}}' FROM built
    UNION ALL SELECT p_partkey, 'summary', '{{"addresses":' || k || ',"codes":1,"seeds":0,"implementations_resolved":3,"origins":' || {_ORIGIN_COUNTS} || ',"alerts_by_seed":['
      || CASE WHEN kind < 9 THEN '{{"label":"a","seed_address":"b","count":1}},{{"label":"c","seed_address":"d","count":2}}' ELSE '' END
      || '],"recent":{{"blocks":100,"by_origin":' || {_ORIGIN_COUNTS} || '}}}}' FROM built
    UNION ALL SELECT p_partkey, 'clusters', '{{"level":"exact","n":' || k || ',"clusters":[{{"level":"exact","key":"' || md5(k) || '","members":["' || address || '"]}},{{"level":"exact","key":"","members":[]}}]}}' FROM built
  ) views)"""


_built: dict[tuple[str, str], DataFrame] = {}


def _spark(sql: str) -> str:
    return sql.replace(" // ", " DIV ")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Views of the tables, and ``built`` over them: long expressions, so it is computed once and written."""
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # a file of some MB is one task's, and the codes made of it are a hundred times as long
        (table.repartition("p_partkey") if name == "part" else table).createOrReplaceTempView(name)
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        _built.clear()
        _built[key] = written(spark.sql(_spark(f"WITH {BUILT} SELECT * FROM built")), "built")
    _built[key].createOrReplaceTempView("built")


def over_built(spark: SparkSession, sf_dir: str, cte: str) -> DataFrame:
    """The frame of one common table expression over the registered views."""
    register(spark, sf_dir)
    return spark.sql(_spark(re.fullmatch(r"\s*\w+ AS \((.*)\)\s*", cte, re.S)[1]))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, hx, block, origin, implementation)."""
    return over_built(spark, sf_dir, _CONTRACTS)


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_built(spark, sf_dir, SEEDS)


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, address, created)."""
    return over_built(spark, sf_dir, RECEIPTS)


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract codes and document bytes: (hx)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("lower(hex(text)) AS hx")
    return contracts(spark, sf_dir).select("hx").union(docs).filter("hx <> ''").distinct()
