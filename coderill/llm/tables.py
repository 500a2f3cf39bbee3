"""Reading the input tables, and materialising a result where executors share a folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The context's checkpoint folder: the one in ``spark.checkpoint.dir``.

    Only where neither that setting nor a folder of the context exists, as in tests in one JVM, a
    temporary one is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="coderill-"))
    return context.getCheckpointDir()


def stage_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for tables that stages hand on."""
    return f"{_shared(spark)}/stages-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the session's checkpoint folder and cut its lineage."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the checkpoint folder, compressed, and read it again."""
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shards(df: DataFrame, text: str, per_shard: int = 16 << 20, least: int = 8, per_row: int = 4096) -> int:
    """A power of two that grows with the bytes of ``text``: about ``per_shard`` bytes each, or what leaves ``per_row``
    bytes for each two shards, whichever is more."""
    total = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    each = max(per_shard, math.isqrt(per_row * total))
    n = least
    while n * each < total:
        n *= 2
    return n


#: Rows of a group from which on it is joined apart from the others, and groups that are broadcast at most.
CROWDED = 1_000
BROADCAST_GROUPS = 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Rows with the columns of their group, of which there is one; ``n`` is how many rows a group has.

    Crowded groups are few and go to all tasks, so that none meets in one; where they are too many for that, their
    rows are dealt by a hash as well.
    """
    crowded, others = groups.filter(F.col(n) > CROWDED), groups.filter(F.col(n) <= CROWDED)
    known = crowded.count()
    if not known:
        return rows.join(others, keys)
    if known <= BROADCAST_GROUPS:
        apart = rows.join(F.broadcast(crowded), keys)
        rest = rows.join(F.broadcast(crowded.select(*keys)), keys, "left_anti")
        return apart.unionByName(rest.join(others, keys))
    salts = 16
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    spread = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("__salt", F.col("__salt").cast("long"))
    return salted.join(spread, [*keys, "__salt"]).drop("__salt")
