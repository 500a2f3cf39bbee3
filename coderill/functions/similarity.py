"""Similarity of two fingerprints and of two codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALERT_MIN, CODE_MIN, SEARCH_MIN = 0.75, 0.6, 0.8


def jaccard(a: Column, b: Column) -> Column:
    """Unrounded share of common members of two sets without repeats; zero where both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def score_of(kind: Column, target: Column, std: Column, selectors: Column, kind_b: Column, target_b: Column, std_b: Column, selectors_b: Column) -> Column:
    """Of the fields of two fingerprints: delegations by target, others by selectors."""
    alike = F.coalesce((kind == kind_b) & (target == target_b), F.lit(False))
    return F.when(kind.isNotNull() | kind_b.isNotNull(), alike.cast("double")).when(std | std_b, F.lit(0.0)).otherwise(jaccard(selectors, selectors_b))


def score(a: str, b: str) -> Column:
    """Of the fingerprints under two column prefixes."""
    fields = ("proxy_kind", "proxy_target", "std_proxy", "selectors")
    return score_of(*(F.col(f"{side}{name}") for side in (a, b) for name in fields))


def code_similarity(a: Column, b: Column) -> Column:
    """Of two sets of opcode runs: zero if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(jaccard(a, b))
