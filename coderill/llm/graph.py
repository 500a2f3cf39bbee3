"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregate of minima and one join, over edges only, and the number of edges never grows.
Nothing meets on the driver but a count and a checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.llm.tables import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """From (a, b) with b < a: every neighbour of a node is tied to the smallest around it."""
    out = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        out = out.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = out.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = out.join(least, "u")
    if both_ways:  # large star: larger neighbours
        return tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    # small star: the node itself and its other smaller neighbours
    kept = tied.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return kept.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge (a, b), the smallest node it reaches, itself included."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialise(edges)
    before = _state(edges)
    while before[0]:
        edges = materialise(_stars(_stars(edges, True), False))
        now = _state(edges)
        if now == before:
            break
        before = now
    # stars now: every node points at its component's smallest
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


class Forest:
    """Union-find over small integers; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        root = i
        while parent[root] != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True
