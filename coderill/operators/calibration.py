"""Quality of alert thresholds against labelled pairs of addresses."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coderill.functions.similarity import CODE_MIN
from coderill.operators.similarity import FIELDS, Index, class_pairs

GRID = (0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0)
_ADDRESS = re.compile(r"0x[0-9a-fA-F]{40}")


def parse_grid(text: str) -> list[float]:
    """Thresholds from 0 to 1, in their order, repeats included."""
    out = []
    for part in text.split(","):
        try:
            value = float(part)
        except ValueError:
            value = math.nan
        if not 0 <= value <= 1:
            raise ValueError(f"not a threshold between 0 and 1: {part.strip()!r}")
        out.append(value)
    return out


def load_labels(path: str) -> dict[str, list]:
    """Labelled pairs and strict addresses of a JSON file, in lower case; other keys are ignored."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise ValueError(f"labels can't be read: {error}".splitlines()[0]) from error
    if not isinstance(data, dict):
        raise ValueError("labels are no JSON object")

    def one(x: object) -> str:
        if not isinstance(x, str) or not _ADDRESS.fullmatch(x):
            raise ValueError(f"not an address: {x!r}")
        return x.lower()

    out: dict[str, list] = {"strict": [one(x) for x in _listed(data, "strict")]}
    for key in ("positives", "negatives"):
        out[key] = []
        for pair in _listed(data, key):
            if not isinstance(pair, list) or len(pair) != 2:
                raise ValueError(f"{key}: not a pair of addresses: {pair!r}")
            out[key].append([one(pair[0]), one(pair[1])])
    return out


def _listed(data: dict, key: str) -> list:
    rows = data.get(key, [])
    if not isinstance(rows, list):
        raise ValueError(f"{key} is no list")
    return rows


def label_frames(spark: SparkSession, labels: dict[str, list]) -> tuple[DataFrame, DataFrame]:
    pairs = [(k, kind, a, b) for kind in ("positives", "negatives") for k, (a, b) in enumerate(labels[kind])]
    return spark.createDataFrame(pairs, "k long, kind string, a string, b string"), spark.createDataFrame([(x,) for x in labels["strict"]], "address string")


def evaluate(pairs: DataFrame, strict: DataFrame, stored: DataFrame, codes: DataFrame, grid: list[float] = list(GRID), code_min: float = CODE_MIN, index: Index | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda frame, name: frame.persist()) -> DataFrame:
    """(position, threshold, recall, negatives, benign, interface_only, benign_total).

    Each labelled pair is checked both ways, each address in turn as the seed. Benign are codes of no
    labelled address; interface_only are those hit by a seed that is not strict, with unlike opcode runs.
    ``keep`` is given what is read more than once, and its name.
    """
    labelled = pairs.select(F.col("a").alias("address")).union(pairs.select("b")).distinct()
    held = keep(labelled.join(stored.filter("code_id IS NOT NULL").select("address", "code_id"), "address"), "held")
    is_strict = strict.distinct().withColumn("strict", F.lit(True))
    seeds = held.join(is_strict, "address", "left").select("address", "code_id", F.coalesce("strict", F.lit(False)).alias("strict"))
    index = index or Index(codes)
    keys = ["set_key", "runs_key"]
    seeds = keep(seeds.join(index.keyed, "code_id", "left").withColumnsRenamed({"set_key": "a_key", "runs_key": "a_runs_key"}), "labelled")
    used = keep(codes.join(held.select("code_id"), "code_id", "left_semi").select(*FIELDS, "runs"), "used")
    own = seeds.filter("a_key IS NOT NULL").select("a_key", "a_runs_key", "strict").distinct()
    wanted = own.select(F.col("a_key").alias("set_key"), F.col("a_runs_key").alias("runs_key"), F.lit(True).alias("strict")).distinct()
    scores = keep(class_pairs(wanted, used, min(grid), index).drop("strict"), "scores")  # of classes: codes follow by counts
    directed = pairs.select("k", "kind", F.col("a").alias("seed"), F.col("b").alias("other")).union(pairs.select("k", "kind", "b", "a"))
    others = seeds.select(F.col("address").alias("other"), F.col("a_key").alias("b_key"), F.col("a_runs_key").alias("b_runs_key"))
    checks = (
        directed.join(seeds.select(F.col("address").alias("seed"), "a_key", "a_runs_key", "strict"), "seed")
        .join(others, "other")
        .join(scores, ["a_key", "a_runs_key", "b_key", "b_runs_key"], "left")
    )
    scored = checks.select("kind", F.when(_passes(code_min), F.col("score")).alias("score"), F.lit(1).alias("n"))
    positive, negative = F.col("kind") == "positives", F.col("kind") == "negatives"
    reached = lambda column, t: F.coalesce(F.col(column) >= t, F.lit(False))
    by_check = _over_grid(scored, grid, hits=lambda t: positive & reached("score", t), negatives=lambda t: negative & reached("score", t), positives=lambda t: positive)
    # of each class, the greatest score of a seed that it passes, and of one that is not strict and has unlike runs; and its benign codes
    benign = stored.filter("code_id IS NOT NULL").select("code_id").distinct().join(held.select("code_id"), "code_id", "left_anti")
    unlike = F.when(~F.col("strict") & (F.col("code_score") < code_min), F.col("score"))
    hits = scores.join(own, ["a_key", "a_runs_key"]).select(F.col("b_key").alias("set_key"), F.col("b_runs_key").alias("runs_key"), "strict", "score", "code_score")
    greatest = hits.groupBy(keys).agg(F.max(F.when(_passes(code_min), F.col("score"))).alias("score"), F.max(unlike).alias("unlike"))
    counted = keep(benign.join(index.keyed, "code_id", "left").groupBy(keys).agg(F.count(F.lit(1)).alias("n")), "benign")
    by_benign = _over_grid(greatest.join(counted, keys), grid, benign=lambda t: reached("score", t), interface_only=lambda t: reached("unlike", t))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("benign_total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = by_check.join(by_benign, ["position", "threshold"]).crossJoin(total)  # a row for each threshold, and one
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("positives")), F.lit(0.0))
    return out.select("position", "threshold", recall.alias("recall"), zero("negatives").alias("negatives"), zero("benign").alias("benign"), zero("interface_only").alias("interface_only"), "benign_total").orderBy("position")


def _passes(code_min: float) -> Column:
    return ~F.col("strict") | F.coalesce(F.col("code_score") >= code_min, F.lit(False))


def _over_grid(rows: DataFrame, grid: list[float], **tests: Callable[[float], Column]) -> DataFrame:
    """(position, threshold, counts): how many rows, each for ``n``, pass each test at each threshold, in one pass over them."""
    wide = rows.agg(*(F.coalesce(F.sum(F.when(test(t), F.col("n"))), F.lit(0)).alias(f"{name}{k}") for name, test in tests.items() for k, t in enumerate(grid)))
    cells = [F.struct(F.lit(k).alias("position"), F.lit(float(t)).alias("threshold"), *(F.col(f"{name}{k}").alias(name) for name in tests)) for k, t in enumerate(grid)]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def missing(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Labelled addresses without stored code."""
    labelled = pairs.select(F.col("a").alias("address")).union(pairs.select("b")).distinct()
    return labelled.join(stored.filter("code_id IS NOT NULL"), "address", "left_anti").orderBy("address")
