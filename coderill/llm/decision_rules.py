"""Quality rules as a learned decision list, in built-in functions only.

Statistics of each text are DataFrame expressions. Sequential covering learns the list from a bounded
sample of labelled documents: a rule is a conjunction of thresholds, grown one condition at a time by
FOIL's information gain until it covers no good document of its growing part, then pruned from its end
on the other part; the documents it covers are set aside and the next rule is learned from the rest.
What comes out is an ordered ``CASE`` expression.

A null text has no words. Rows keep their number: repeated rows and null ids stay. Extra columns are
dropped before the statistics are made, so none can clash. Without labels the list is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the rules are learned from, at most: they meet on the driver.
MAX_LABELLED = 20_000
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and shares for the rules)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    split = base.select("*", F.filter(F.split("__text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda line: F.length(F.translate(line, _SPACES, "")) > 0)
    counted = split.select(
        "__id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("__text") - F.length(F.translate("__text", "|!", ""))).cast("long").alias("__marks"),
        F.regexp_count("__text", F.lit("\\p{Lu}")).cast("long").alias("__upper"),
        F.size(F.array_distinct("__words")).cast("long").alias("__distinct"),
        lines.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    windowed = counted.select(
        "*",
        F.when(
            F.size("__hashes") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("__hashes") - F.lit(WINDOW)), lambda i: F.xxhash64(*(F.get("__hashes", i + j) for j in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")).alias("__windows"),
    )
    # most texts repeat no window, and only the others are sorted
    placed = windowed.select(
        "*",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("__sorted"),
    )
    repeated = F.filter(
        F.transform(
            "__sorted",
            lambda x, k: F.when(
                (F.get("__sorted", k - 1)["h"] == x["h"]) | (F.get("__sorted", k + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    found = placed.select("*", F.array_sort(repeated).alias("__places"))
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    counts = found.select(
        "__id", "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), "__marks", "__upper", "__distinct", F.size("__lines").alias("__n_lines"),
    )
    # exploding an array of one keeps later filters above it, so that no statistic is computed again for them
    held = counts.select("__id", F.explode(F.array(F.struct(*[c for c in counts.columns if c != "__id"]))).alias("__s")).select("__id", "__s.*")
    return held.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("__marks") / chars).alias("mark_share"),
        (F.col("__upper") / chars).alias("upper_share"),
        (F.col("__distinct") / words).alias("distinct_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("dup_line_share"),
    )


FEATURES = ("mean_word_chars", "symbol_share", "mark_share", "upper_share", "distinct_share", "repeat_share", "dup_line_share")


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature]
        return column >= self.threshold if self.above else column < self.threshold


@dataclass
class DecisionList:
    """Rules in order; a document that any of them covers is rejected."""

    rules: list[list[Condition]] = field(default_factory=list)
    features: tuple[str, ...] = FEATURES

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for rule in self.rules:
            out |= _covered(rule, x)
        return out

    def verdict(self) -> Column:
        """The ordered expression: false at the first rule that holds, else true."""
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                column = F.col(self.features[c.feature])
                test = test & (column >= F.lit(c.threshold) if c.above else column < F.lit(c.threshold))
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _covered(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _thresholds(values: np.ndarray, steps: int = 48) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) > steps:
        distinct = np.unique(np.quantile(distinct, np.linspace(0, 1, steps)))
    return (distinct[1:] + distinct[:-1]) / 2


def _grow(x: np.ndarray, bad: np.ndarray, longest: int) -> list[Condition]:
    rule: list[Condition] = []
    live = np.ones(len(x), dtype=bool)
    while len(rule) < longest and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), (live & ~bad).sum()
        best, best_gain, best_mask = None, 1e-9, live
        for f in range(x.shape[1]):
            for t in _thresholds(x[live, f]):
                for above in (True, False):
                    c = Condition(f, above, float(t))
                    mask = live & c.holds(x)
                    p, n = (mask & bad).sum(), (mask & ~bad).sum()
                    if p == 0:
                        continue
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > best_gain:
                        best, best_gain, best_mask = c, gain, mask
        if best is None:
            break
        rule.append(best)
        live = best_mask
    return rule


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7, longest: int = 4, most: int = 12, precision: float = 0.95) -> DecisionList:
    """Sequential covering of the bad rows; a rule must keep ``precision`` over all rows to be taken."""
    out, rest = DecisionList(), np.ones(len(x), dtype=bool)
    rng = np.random.default_rng(seed)
    while len(out.rules) < most and (rest & bad).sum() >= 2:
        to_grow = rest & (rng.random(len(x)) < 2 / 3)
        to_prune = rest & ~to_grow
        if not (to_grow & bad).any() or not (to_grow & ~bad).any():
            break
        rule = _grow(x[to_grow], bad[to_grow], longest)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            mask = _covered(r, x[to_prune])
            p, n = (mask & bad[to_prune]).sum(), (mask & ~bad[to_prune]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        mask = _covered(rule, x) & rest
        p, n = (mask & bad).sum(), (mask & ~bad).sum()
        if p < 2 or p / (p + n) < precision:
            break
        out.rules.append(rule)
        rest &= ~mask
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Rules from at most ``max_labelled`` labels, those of the lowest id hashes; of several rows or labels of an id, the least counts."""
    sample = (
        labels.select(F.col("doc_id").alias("__label_id"), F.col("quality").alias("__quality"))
        .filter("__label_id IS NOT NULL AND __quality IS NOT NULL")
        .orderBy(F.xxhash64("__label_id"), "__label_id", "__quality")
        .limit(max_labelled)
    )
    frame = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(sample), F.col(id_col) == F.col("__label_id"))
    stats = statistics(frame.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    labelled = stats.join(F.broadcast(sample), F.col(id_col) == F.col("__label_id")).filter(f"n_words >= {MIN_WORDS}")
    one = F.min(F.struct("__quality", *FEATURES)).alias("r")
    rows = labelled.groupBy(F.col(id_col).alias("__own")).agg(one).select("__own", "r.*").orderBy("__own").collect()  # a row for each id of the sample
    if not rows:
        return DecisionList()
    return learn(np.array([[r[f] for f in FEATURES] for r in rows], dtype=float), np.array([r["__quality"] == 0 for r in rows]))


_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"


def accepted(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the decision list keep, with all their columns."""
    whole = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__own_text"))
    stats = statistics(whole, "__row", "__own_text").filter(f"NOT ({_FAILED})")
    return stats.filter(rules.verdict()).select("__row.*")


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    stats = statistics(docs, id_col, text_col).withColumn("base_failed", F.expr(_FAILED))
    return stats.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.verdict()).alias("kept"),
    )
