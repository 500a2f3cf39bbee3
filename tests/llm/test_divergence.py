"""op13 against its definition; its SQL is held to it in test_truth."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from coderill.llm import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, item string, p long"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def truth(rows, least=10, top=10):
    rows = [(t, lang or "", source or "") for t, lang, source in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        df[lang].update(set(terms_of(text)))
        n[lang, source].update(terms_of(text))
    out = []
    for lang in {lang for _, lang, _ in rows}:
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        groups = sorted({source for _, x, source in rows if x == lang})
        counts = {g: [n[lang, g][t] for t in kept] for g in groups}
        whole = [sum(c) for c in zip(*counts.values())] if kept else []
        share = lambda c: [1 + 10**9 * (k + 2) // (sum(c) + 2 * len(kept)) for k in c]
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {g: share(c) for g, c in counts.items()}, share(whole)
        for g in groups:
            pairs = [(sum(map(apart, p[g], p[h])), h) for h in groups if h != g]
            best = [(apart(p[g][k], q[k]), t) for k, t in enumerate(kept) if counts[g][k] and p[g][k] > q[k]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, g, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def found(frame):
    return sorted(map(tuple, frame.collect()))


def table(spark, rows):
    return spark.createDataFrame([(1, t, lang, source, "x", 1, "y", 2) for t, lang, source in rows], SCHEMA)


def corpus():
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("Ab", "éC", "x-y", "ß9z", "日本", "it's") for b in "klmnop"]
    rows = [(" ".join(rng.choice(words[: 10 + 6 * (k % 5)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "É", None])) for k in range(160)]
    rows += [(None, "en", "a"), ("", "xx", "only"), (None, "xx", "other"), ("rare words here", "fr", "one"), ("Ab " * 5000, "en", "long"), ("zz zz", "en", "none kept")]
    return rows + rows[:9]


def test_terms():
    assert [t.decode() for t in source_divergence.terms("It's ÀB-ção_X9y\x00z日本 Ω".encode())] == terms_of("It's ÀB-ção_X9y\x00z日本 Ω")


@pytest.mark.parametrize("width,most,few", [(source_divergence.WIDTH, 1 << 19, 10_000), (64, 20, 0)])
def test_definition(spark, monkeypatch, width, most, few):
    """Also where the sketch is crowded, tables of a task are handed over early, and the groups are joined by a shuffle."""
    monkeypatch.setattr(source_divergence, "_MOST", most)
    monkeypatch.setattr(source_divergence, "FEW_GROUPS", few)
    rows = corpus()
    assert found(source_divergence.audit(table(spark, rows).repartition(3), width=width)) == truth(rows)


def test_sketch_never_underestimates(spark):
    rows = corpus()
    texts = table(spark, rows).select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).repartition(5)
    for width in (32, 1 << 12):
        bits = source_divergence.sketch(texts, width=width)
        df = defaultdict(Counter)
        for text, lang, _ in rows:
            df[lang or ""].update({t.encode() for t in terms_of(text)})
        passed = 0
        for lang, n in df.items():
            every = list(n)
            allowed = bits[source_divergence._cells(lang, every, width, source_divergence.DEPTH)].all(axis=0)
            assert all(ok for t, ok in zip(every, allowed) if n[t] >= 10)
            passed += int(np.sum([ok and n[t] < 10 for t, ok in zip(every, allowed)]))
        assert passed == 0 or width == 32


def test_empty_and_single(spark):
    assert found(source_divergence.audit(table(spark, []))) == []
    one = [("word " * 3, "en", "a")] * 12
    assert found(source_divergence.audit(table(spark, one))) == truth(one)
