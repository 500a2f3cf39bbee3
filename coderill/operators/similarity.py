"""Exact set-similarity joins of codes by their selectors.

Many codes share one selector set and one set of opcode runs, so these are joined and scored, each once, and codes and addresses after them; an
``Index`` of them is made once for all joins with the same codes. With a threshold ``t > 0``
two sets can only reach it if they share one of their first ``n - ceil(t n) + 1`` selectors, rarest first,
and if their sizes are within a factor of ``t``; the candidates of this index are verified.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coderill.functions import bytecode as B
from coderill.functions.similarity import ALERT_MIN, CODE_MIN, code_similarity, jaccard, score, score_of

FIELDS = ("code_id", "proxy_kind", "proxy_target", "std_proxy", "selectors")
_PLAIN = "proxy_kind IS NULL AND NOT std_proxy AND size(selectors) > 0"
_SCORED = FIELDS[1:]
#: Codes of like selectors and like opcode runs.
CLASS = ("set_key", "runs_key")
#: Codes on the left of one task's share of the pairs with a set. A row is shuffled for so many pairs.
SHARE = 2000


def _keyed(codes: DataFrame) -> DataFrame:
    """Codes with ``set_key`` of what their scores depend on: the delegation, or the selectors; and ``runs_key`` of their opcode runs, if they have any here."""
    target = F.concat("proxy_kind", F.lit(":"), "proxy_target")
    of_set = F.when(F.col("proxy_kind").isNotNull(), target).when(F.col("std_proxy"), "standard").otherwise(F.sha2(F.array_join("selectors", ","), 256))
    of_runs = F.sha2(F.array_join(F.col("runs").cast("array<string>"), ","), 256) if "runs" in codes.columns else F.lit("")
    return codes.withColumn("set_key", of_set).withColumn("runs_key", of_runs)


class Index:
    """What joins need of the codes on their right side, made once for any number of them, and each part when a join first asks for it.

    ``keyed`` has (code_id, set_key, runs_key), ``kinds`` the scored fields of each set_key, ``sets`` (set_key, selectors) of those that are scored by
    selectors, ``postings`` (selector, set_key, size), ``counts`` the number of sets of a selector and ``runs`` (runs_key, runs).
    ``keep`` is given each frame and its name, and returns it as it is read.
    """

    def __init__(self, codes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda frame, name: frame):
        self._rows, self.keep = _keyed(codes), keep

    @functools.cached_property
    def keyed(self) -> DataFrame:
        return self.keep(self._rows.select("code_id", "set_key", "runs_key"), "keyed")

    @functools.cached_property
    def kinds(self) -> DataFrame:
        return self.keep(self._rows.select("set_key", *_SCORED).dropDuplicates(["set_key"]), "kinds")

    @functools.cached_property
    def sets(self) -> DataFrame:
        return self.kinds.filter(_PLAIN).select("set_key", "selectors")

    @functools.cached_property
    def postings(self) -> DataFrame:
        return self.keep(self.sets.select(F.explode("selectors").alias("selector"), "set_key", F.size("selectors").alias("size")), "postings")

    @functools.cached_property
    def counts(self) -> DataFrame:
        return self.keep(self.postings.groupBy("selector").agg(F.count(F.lit(1)).alias("n")), "counts")

    @functools.cached_property
    def classes(self) -> DataFrame:
        return self.keep(self.keyed.select("set_key", "runs_key").distinct(), "classes")

    @functools.cached_property
    def runs(self) -> DataFrame | None:
        return self.keep(self._rows.select("runs_key", "runs").dropDuplicates(["runs_key"]), "runs") if "runs" in self._rows.columns else None


def _prefixed(sets: DataFrame, counts: DataFrame, t: float) -> DataFrame:
    """(set_key, selector, size) for the prefix of each set, rarest selectors first."""
    rows = sets.select("set_key", F.explode("selectors").alias("selector")).join(counts, "selector", "left")
    ordered = rows.groupBy("set_key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "selector"))).alias("s"))
    # a hair less than t n, so that rounding never shortens a prefix
    keep = F.size("s") - F.ceil(F.lit(t) * F.size("s") - 1e-9).cast("int") + 1
    return ordered.select("set_key", F.size("s").alias("size"), F.explode(F.slice("s", F.lit(1), keep)).alias("e")).select("set_key", F.col("e.selector").alias("selector"), "size")


def score_sets(left: DataFrame, index: Index, t: float, whole: bool) -> DataFrame:
    """(a_key, b_key, score) of sets (set_key, selectors) with those of the index that reach ``t`` > 0.

    Prefixes of the left sets meet all selectors of the right ones, or with ``whole`` (many left sets) their prefixes.
    """
    prefixes = _prefixed(left, index.counts, t).select(F.col("set_key").alias("a_key"), "selector", F.col("size").alias("a_size"))
    right = _prefixed(index.sets, index.counts, t) if whole else index.postings
    near = prefixes.join(right.select("selector", F.col("set_key").alias("b_key"), F.col("size").alias("b_size")), "selector")
    near = near.filter(F.least("a_size", "b_size") >= F.lit(t) * F.greatest("a_size", "b_size") - 1e-9).select("a_key", "b_key").distinct()
    sized = near.join(left.select(F.col("set_key").alias("a_key"), F.col("selectors").alias("x")), "a_key")
    sized = sized.join(index.sets.select(F.col("set_key").alias("b_key"), F.col("selectors").alias("y")), "b_key")
    return sized.withColumn("score", jaccard(F.col("x"), F.col("y"))).filter(F.col("score") >= t).select("a_key", "b_key", "score")


def _dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """By keys to all shuffle partitions: small sides of a join that multiplies rows are not to meet in a few tasks."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def score_keys(left: DataFrame, index: Index, t: float, whole: bool = False) -> DataFrame:
    """(a_key, b_key, score): the keys of ``left`` (set_key and scored fields, each once) with those of the index that reach ``t``.

    ``t`` of zero or less pairs all keys with all, which is the only case of a cross join: it is asked for.
    """
    if t <= 0:
        a, b = (side.select(F.col("set_key").alias(f"{p}key"), *(F.col(c).alias(f"{p}{c}") for c in _SCORED)) for side, p in ((left, "a_"), (index.kinds, "b_")))
        return a.crossJoin(b).withColumn("score", score("a_", "b_")).filter(F.col("score") >= t).select("a_key", "b_key", "score")
    targets = left.filter("proxy_kind IS NOT NULL").select("set_key").join(index.kinds.filter("proxy_kind IS NOT NULL").select("set_key"), "set_key", "left_semi")
    same = targets.select(F.col("set_key").alias("a_key"), F.col("set_key").alias("b_key"), F.lit(1.0).alias("score")).filter(F.lit(1.0) >= t)
    return score_sets(left.filter(_PLAIN).select("set_key", "selectors"), index, t, whole).unionByName(same)


def score_pairs(left: DataFrame, right: DataFrame, t: float, index: Index | None = None, whole: bool | None = None) -> DataFrame:
    """(a, b, score): codes of ``left`` and ``right`` (FIELDS) that reach ``t``, both ways and with themselves.

    An ``index`` of the right side is for a left side of few codes, or with ``whole`` of many. Then codes that meet one set are dealt to tasks in shares,
    and the codes of that set to each share: its pairs grow with the product of both, whatever the number of sets.
    """
    whole, index = index is None if whole is None else whole, index or Index(right.select(*FIELDS))
    own = index.keyed.select("code_id", "set_key") if left is right else _keyed(left.select(*FIELDS))
    kinds = index.kinds if left is right else own.select("set_key", *_SCORED).dropDuplicates(["set_key"])
    found, held = score_keys(kinds, index, t, whole), index.keyed.select(F.col("set_key").alias("b_key"), F.col("code_id").alias("b"))
    own = own.select(F.col("set_key").alias("a_key"), F.col("code_id").alias("a"))
    if not whole:
        return _dealt(index.keep(found, "found").join(own, "a_key"), "b_key").join(held, "b_key").select("a", "b", "score")
    n = own.groupBy("a_key").agg(F.count(F.lit(1)).alias("n"))
    shares = F.ceil(F.sum("n").over(Window.partitionBy("b_key")) / SHARE).cast("int")
    found = index.keep(found.join(n, "a_key").select("a_key", "b_key", "score", shares.alias("shares")), "found")
    held = index.keep(held.join(found.select("b_key", "shares").distinct(), "b_key"), "held")
    held = held.select("b_key", "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    codes = found.join(own, "a_key").withColumn("share", F.pmod(F.xxhash64("a"), "shares").cast("int"))
    return _dealt(codes, "b_key", "share").join(held, ["b_key", "share"]).select("a", "b", "score")


def class_pairs(left: DataFrame, codes: DataFrame, t: float, index: Index) -> DataFrame:
    """(a_key, a_runs_key, strict, b_key, b_runs_key, score, code_score) of classes, which are codes of like selectors and like opcode runs.

    ``left`` has the classes (set_key, runs_key, strict) of ``codes`` that are wanted; ``code_score`` is null where ``strict`` is false. No two sets
    of runs are compared twice.
    """
    rows = _keyed(codes)
    wanted = left.select("set_key").distinct()
    found = score_keys(rows.select("set_key", *_SCORED).dropDuplicates(["set_key"]).join(wanted, "set_key", "left_semi"), index, t)
    pairs = found.join(left.select(F.col("set_key").alias("a_key"), F.col("runs_key").alias("a_runs_key"), "strict"), "a_key")
    pairs = index.keep(pairs.join(index.classes.select(F.col("set_key").alias("b_key"), F.col("runs_key").alias("b_runs_key")), "b_key"), "pairs")
    near = pairs.filter("strict").select("a_runs_key", "b_runs_key").distinct()
    x = rows.select(F.col("runs_key").alias("a_runs_key"), F.col("runs").alias("x")).dropDuplicates(["a_runs_key"])
    y = index.runs.select(F.col("runs_key").alias("b_runs_key"), F.col("runs").alias("y"))
    scored = near.join(x, "a_runs_key").join(y, "b_runs_key").select("a_runs_key", "b_runs_key", code_similarity(F.col("x"), F.col("y")).alias("code_score"), F.lit(True).alias("strict"))
    return pairs.join(scored, ["a_runs_key", "b_runs_key", "strict"], "left").select("a_key", "a_runs_key", "strict", "b_key", "b_runs_key", "score", "code_score")


def code_pairs(left: DataFrame, t: float, index: Index) -> DataFrame:
    """(a, b, score, code_score): codes of ``left`` with those of the index that reach ``t``, and the similarity of their opcode runs."""
    own = _keyed(left).select(F.col("code_id").alias("a"), F.col("set_key").alias("a_key"), F.col("runs_key").alias("a_runs_key"))
    classes = own.select(F.col("a_key").alias("set_key"), F.col("a_runs_key").alias("runs_key"), F.lit(True).alias("strict")).distinct()
    pairs = index.keep(class_pairs(classes, left, t, index), "scored").join(own, ["a_key", "a_runs_key"])
    right = index.keyed.select(F.col("code_id").alias("b"), F.col("set_key").alias("b_key"), F.col("runs_key").alias("b_runs_key"))
    # the codes of the index stream by, each beside the fewer ones of its class: rows of one code are neighbours, which files keep small
    return _dealt(right, "b_key", "b_runs_key").join(pairs, ["b_key", "b_runs_key"]).select("a", "b", "score", "code_score")


def similarity_of(a: Column, b: Column) -> Column:
    """Similarity of two codes given as hexadecimal text: the score of their fingerprints."""

    # bound as the element of an array of one, so that instructions and fingerprints are made once
    once = lambda x, then: F.get(F.transform(F.array(x), then), F.lit(0))
    made = lambda hx: once(B.tokens(B.body(hx)), lambda tok: F.struct(B.is_standard_proxy(tok).alias("standard"), B.selectors(tok).alias("selectors")))
    # targets stay outside of functions, where Spark 4.1 gives nullif() wrong
    sides = F.struct(*(F.struct(B.proxy_kind(hx).alias("kind"), B.proxy_target(hx).alias("target"), made(hx).alias("made")).alias(name) for name, hx in (("a", a), ("b", b))))
    fields = lambda x: (x["kind"], x["target"], x["made"]["standard"], x["made"]["selectors"])
    return once(sides, lambda s: score_of(*fields(s["a"]), *fields(s["b"])))


def find_similar(codes: DataFrame, effective: DataFrame, address: str, t: float, index: Index | None = None) -> DataFrame:
    """(address, score): addresses whose effective code is as similar to that of ``address``, itself left out."""
    own = effective.filter(F.col("address") == address.lower()).select("code_id")
    query = codes.join(own, "code_id", "left_semi")
    pairs = score_pairs(query, codes, t, index or Index(codes))
    out = pairs.join(effective, pairs["b"] == effective["code_id"]).filter(F.col("address") != address.lower())
    return out.select("address", "score").orderBy(F.desc("score"), "address")


def hits(codes: DataFrame, seeds: DataFrame, index: Index, t: float = ALERT_MIN, code_min: float = CODE_MIN) -> DataFrame:
    """(set_key, runs_key, seed_address, label, score): classes of the index near a seed's code; strict seeds need like opcode runs too."""
    seed_codes = index.keep(codes.join(seeds.select("code_id"), "code_id", "left_semi").select(*FIELDS, "runs"), "seed_codes")
    keyed = _keyed(seed_codes).select("code_id", F.col("set_key").alias("a_key"), F.col("runs_key").alias("a_runs_key"))
    own = seeds.select("code_id", F.col("address").alias("seed_address"), "label", "strict").join(keyed, "code_id").drop("code_id")
    classes = own.select(F.col("a_key").alias("set_key"), F.col("a_runs_key").alias("runs_key"), "strict").distinct()
    pairs = class_pairs(classes, seed_codes, t, index).filter(~F.col("strict") | (F.col("code_score") >= code_min))
    return pairs.join(own, ["a_key", "a_runs_key", "strict"]).select(F.col("b_key").alias("set_key"), F.col("b_runs_key").alias("runs_key"), "seed_address", "label", "score")


def match(new_codes: DataFrame, codes: DataFrame, seeds: DataFrame, t: float = ALERT_MIN, code_min: float = CODE_MIN, index: Index | None = None) -> DataFrame:
    """(code_id, seed_address, label, score): codes near a seed's; strict seeds need like opcode runs too. Greatest scores first."""
    index = index or Index(new_codes)
    kept = hits(codes, seeds, index, t, code_min).join(index.keyed, ["set_key", "runs_key"])
    return kept.select("code_id", "seed_address", "label", "score").orderBy(F.desc("score"), "seed_address")


def members(stored: DataFrame, effective: DataFrame, index: Index) -> DataFrame:
    """(address, set_key, runs_key, origin, block): addresses by the class of the code that they are scored by."""
    origins = stored.select("address", "origin", "block")
    rows = effective.join(index.keyed, "code_id").join(origins, "address", "left")
    return rows.select("address", *CLASS, F.coalesce("origin", F.lit("unknown")).alias("origin"), "block")


def to_members(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their class, an address each, beside what was found for that class, but never beside itself."""
    return to_classes(rows, found).filter("address <> seed_address")


def to_classes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their class (set_key, runs_key) beside what was found for it."""
    return _dealt(rows, *CLASS).join(found, list(CLASS))


def alerts(stored: DataFrame, codes: DataFrame, seeds: DataFrame, effective: DataFrame, t: float = ALERT_MIN, code_min: float = CODE_MIN, origin: str | None = None, index: Index | None = None, found: DataFrame | None = None) -> DataFrame:
    """(address, seed_address, label, score, origin, block) over the whole store in no order, an address never with itself; ``found`` are the ``hits``, where they are made."""
    index = index or Index(codes)
    rows = members(stored, effective, index)
    rows = rows if origin is None else rows.filter(F.col("origin") == origin)
    return to_members(rows, hits(codes, seeds, index, t, code_min) if found is None else found).select("address", "seed_address", "label", "score", "origin", "block")


def alert_counts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(seed_address, label, n): alerts of each seed, from numbers of ``members`` by class; no alert is made."""
    held = rows.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"))
    own = rows.select(*CLASS, F.col("address").alias("seed_address"), F.lit(-1).cast("long").alias("n"))  # an address is no alert of itself
    parts = found.join(held, list(CLASS)).select("seed_address", "label", "n").unionByName(found.join(own, [*CLASS, "seed_address"]).select("seed_address", "label", "n"))
    return parts.groupBy("seed_address", "label").agg(F.sum("n").alias("n")).filter("n > 0")


def recheck(stored: DataFrame, codes: DataFrame, seeds: DataFrame, effective: DataFrame, t: float = ALERT_MIN, code_min: float = CODE_MIN, origin: str | None = None, index: Index | None = None, found: DataFrame | None = None) -> DataFrame:
    """(address, seed_address, label, score, origin): alerts over the whole store, an address never with itself."""
    return alerts(stored, codes, seeds, effective, t, code_min, origin, index, found).drop("block").orderBy("address", F.desc("score"), "seed_address")


def interface_hits(codes: DataFrame, seeds: DataFrame, t: float = ALERT_MIN, code_min: float = CODE_MIN, index: Index | None = None) -> DataFrame:
    """(seed_address, hits): other codes with like selectors but unlike opcode runs."""
    seed_codes = codes.join(seeds.select("code_id"), "code_id", "left_semi")
    pairs = code_pairs(seed_codes, t, index or Index(codes)).filter("a <> b")
    found = pairs.filter(F.col("code_score") < code_min).groupBy("a").agg(F.count(F.lit(1)).alias("hits"))
    return seeds.join(found, seeds["code_id"] == found["a"], "left").select(F.col("address").alias("seed_address"), F.coalesce("hits", F.lit(0)).alias("hits"))
