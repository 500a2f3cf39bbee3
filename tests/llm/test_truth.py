"""Queries against their SQL in DuckDB, and statistics, scores and licenses against plain implementations."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from coderill.llm import decision_rules, deleted_interpolation, license_scan, queries
from coderill.llm.license_texts import TEXTS

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACE = r"[\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    frame, want = queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def plain_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by definition."""
    words, text = words_of(text), text or ""
    lines = [line for line in text.split("\n") if words_of(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            repeated.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_statistics_are_those_of_the_definition(spark):
    rng = np.random.default_rng(4)
    pieces = ["a", "b", "cc", "é🙂", "#x", "<b>", "$$", "\n", "\n\n", "\t", "\x0b", "  ", " ", " ", "Z"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", " ", "\n"]) for _ in range(rng.integers(0, 60))) for _ in range(300)]
    texts += [None, "", " \n ", "a b c d e " * 50, "one two\none two\n\none two", "x\ny\nx\n x\n", "w" * 100_000, "long text " * 60_000]
    frame = spark.createDataFrame([(k, t, 1, True) for k, t in enumerate(texts)] + [(None, "a", 1, True)], "doc_id long, text string, n_words int, kept boolean")
    got = decision_rules.judge(frame, decision_rules.DecisionList())
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = {r.doc_id: r for r in got.collect()}
    for k, text in enumerate(texts[:-1]):
        want = plain_statistics(text)
        assert tuple(rows[k])[1:6] == want, (k, text)
        assert rows[k].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and rows[k].kept == (not rows[k].base_failed)
    assert tuple(rows[len(texts) - 1])[1:7] == (120_000, 480_000, 0, 0, 120_000, True) and rows[None].n_words == 1
    assert decision_rules.judge(frame.limit(0), decision_rules.DecisionList()).count() == 0


def test_rules_are_learned_from_bounded_labels(spark):
    """Repeated rows and labels of an id count once, and change nothing."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{rng.integers(1000)}" + ("!!||" if k % 4 == 0 else "") for _ in range(30))) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    once = decision_rules.fit(frame, labels)
    again = decision_rules.fit(frame.union(frame).union(frame.limit(1)), labels.union(labels))
    assert once.rules and once == again
    x = np.array([[r[f] for f in decision_rules.FEATURES] for r in decision_rules.statistics(frame).orderBy("doc_id").collect()])
    verdicts = {r.doc_id: r.kept for r in decision_rules.judge(frame, once).collect()}
    assert [not verdicts[k] for k, _ in rows] == once.covers(x).tolist()  # the expression says what the list says
    assert [not verdicts[k] for k, _ in rows] == [k % 4 == 0 for k, _ in rows]


def plain_scores(rows):
    """Deleted interpolation of exact counts, without cells."""
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = lambda t: [*(w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w), None]
    word, pair, start = {}, {}, 0
    for k, t in rows:
        if not held(k):
            start += 1
            before = "<s>"
            for w in tokens(t):
                word[w] = word.get(w, 0) + 1
                pair[before, w] = pair.get((before, w), 0) + 1
                before = w
    n, v = sum(word.values()), len(word)
    context = lambda h: start if h == "<s>" else word.get(h, 0)
    bucket = lambda c: math.frexp(c)[1]
    seen = []
    for k, t in rows:
        if not held(k):
            before = "<s>"
            for w in tokens(t):
                c = context(before) - 1
                seen.append((bucket(c), (pair[before, w] - 1) / max(c, 1), (word[w] - 1) / (n - 1)))
                before = w
    weights = {b: [1 / 3] * 3 if b else [0, 0.5, 0.5] for b, *_ in seen}
    for _ in range(deleted_interpolation.ROUNDS):
        new = {b: [0.0] * 3 for b in weights}
        for b, p2, p1 in seen:
            parts = [x * y for x, y in zip(weights[b], (p2, p1, 1 / (v + 1)))]
            for i, x in enumerate(parts):
                new[b][i] += x / sum(parts)
        weights = {b: [x / sum(xs) for x in xs] for b, xs in new.items()}
    out = {}
    for k, t in rows:
        before, total = "<s>", 0.0
        for w in tokens(t):
            x = weights.get(bucket(context(before)), [1 / 3] * 3)
            total += math.log10(x[0] * pair.get((before, w), 0) / max(context(before), 1) + x[1] * word.get(w, 0) / n + x[2] / (v + 1))
            before = w
        out[k] = total
    return out


def test_scores_are_those_of_exact_counts(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(250):
        at, words = 0, []
        for _ in range(rng.integers(0, 40)):
            at = (7 * at + int(rng.integers(0, 4))) % 60  # what follows depends on what is before
            words.append(vocabulary[at] if rng.random() < 0.9 else f"rare{rng.integers(300)}")
        rows.append((k, " ".join(words).upper() if k % 9 == 0 else " ".join(words)))
    frame = spark.createDataFrame([(k, t, 0, 1) for k, t in rows], "doc_id long, text string, chunk int, score int")
    got = {r.doc_id: r for r in deleted_interpolation.score(frame).collect()}
    want = plain_scores(rows)
    assert all(abs(got[k].score - want[k]) <= 0.03 * abs(want[k]) + 0.05 for k in want)
    held = [k for k in want if got[k].held_out and got[k].n_tokens > 5]
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held)  # better than the base on texts it has not seen


def test_scores_of_odd_tables(spark):
    frame = spark.createDataFrame([(2, "a"), (2, "a")], "doc_id long, text string")
    assert deletions(frame.limit(0)) == []
    only_held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 == 2)
    rows = deletions(spark.createDataFrame([(only_held, "a b"), (only_held, None)], "doc_id long, text string"))
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}  # N and V are 0
    long = deletions(spark.createDataFrame([(1, "ab cd " * 400_000), (3, "ab")], "doc_id long, text string"))
    assert sorted(r.n_tokens for r in long) == [2, 800_001] and all(math.isfinite(r.score) for r in long)


def deletions(frame):
    return deleted_interpolation.score(frame).collect()


def test_licenses_in_longer_files(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{rng.integers(500)}" for _ in range(n))

    def wrapped(text, mark="# "):
        words, lines = text.split(), []
        for i in range(0, len(words), 9):
            lines.append(mark + " ".join(words[i : i + 9]))
        return "\n".join(lines)

    rows, want = [], {}
    for k, (name, text) in enumerate(sorted(TEXTS.items())):
        rows.append((k, f"{prose(40)}\n\n{wrapped(text)}\n\n{prose(300)}"))
        want[k] = name
    header = license_scan.NOTICES["GPL-header"]
    rows += [(50, f"{prose(30)}\n{wrapped(header, '// ')}\n{prose(200)}"), (51, f"{prose(500)} Released under the MIT License."), (52, prose(2000)), (53, TEXTS["MIT-text"])]
    want |= {50: "GPL-header", 51: "MIT"}
    changed = " ".join(w if i % 13 else "changed" for i, w in enumerate(TEXTS["MIT-text"].split()))
    rows.append((54, f"{prose(20)}\n{changed}\n{prose(20)}"))
    want[54] = "MIT-text"
    found = license_scan.scan(spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, unit int, license string")).collect()
    windows = {}
    for r in found:
        if r.unit < 0:
            windows.setdefault(r.doc_id, set()).add(r.license)
    assert all(name in windows.get(k, ()) for k, name in want.items())
    assert not any(r.doc_id == 52 for r in found) and any(r.doc_id == 53 and r.unit == 1 and r.license == "MIT-text" for r in found)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty).count() == 0
    assert license_scan.scan(spark.createDataFrame([(1, "software " * 200_000), (None, None)], "doc_id long, text string")).count() == 0
