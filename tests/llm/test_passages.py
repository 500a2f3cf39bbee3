"""Passages against brute force: words that an earlier document has in a row of 50 are found, and what is found is alike."""

import numpy as np
import pytest

from coderill.llm import substring_dedup
from coderill.llm.substring_dedup import common_subsequence, cut, passages


def frame_of(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, "s") for k, t in rows], "doc_id long, text string, source string, start int, key string")


def corpus(seed, n=150, stretches=60, changed=0.0):
    """Documents made of stretches of 15 to 90 words that many of them share, in any order, between words of their own."""
    rng = np.random.default_rng(seed)
    pool = [[f"s{i}w{j}" for j in range(rng.integers(15, 90))] for i in range(stretches)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.integers(1, 8)):
            words += [f"own{k}x{len(words)}y{j}" for j in range(rng.integers(0, 20))]
            part = pool[rng.integers(0, stretches)]
            at, to = (0, len(part)) if rng.random() < 0.6 else sorted(rng.integers(0, len(part) + 1, size=2))
            words += [w if rng.random() >= changed else f"new{k}x{rng.integers(1 << 30)}" for w in part[at:to]]
        rows.append((k, words))
    return rows


def repeated(rows, least=50):
    """Of each document, which words lie in ``least`` words in a row that an earlier one has too."""
    seen, out = set(), {}
    for k, words in rows:
        grams = [tuple(words[i : i + least]) for i in range(len(words) - least + 1)]
        mask = np.zeros(len(words), dtype=bool)
        for i, g in enumerate(grams):
            if g in seen:
                mask[i : i + least] = True
        out[k] = mask
        seen.update(grams)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recall_against_brute_force(spark, seed):
    rows = corpus(seed)
    found = passages(frame_of(spark, [(k, " ".join(w)) for k, w in rows])).collect()
    words, wanted = dict(rows), repeated(rows)
    masks = {k: np.zeros(len(w), dtype=bool) for k, w in rows}
    for r in found:
        masks[r.doc_id][r.start : r.end] = True
        a, b = words[r.doc_id][r.start : r.end], words[r.source_id][r.source_start : r.source_end]
        ids = {w: i for i, w in enumerate(sorted({*a, *b}))}
        both = common_subsequence(np.array([ids[w] for w in a]), np.array([ids[w] for w in b]))
        assert r.source_id < r.doc_id and 50 <= r.n_equal <= both and r.identity >= 0.75
    hit = sum(int((masks[k] & wanted[k]).sum()) for k in masks)
    whole = sum(int(m.sum()) for m in wanted.values())
    assert whole > 2000 and hit >= 0.98 * whole
    spans = sorted((r.doc_id, r.start, r.end) for r in found)
    assert all(a[0] != b[0] or a[2] < b[2] and a[1] < b[1] for a, b in zip(spans, spans[1:]))  # none lies in another


def test_parts_of_a_shared_passage_in_other_documents(spark):
    p = [f"p{i}" for i in range(70)]
    rows = [(1, ["a", *p[:44], "b"]), (2, ["c", *p[28:], "d"]), (3, ["e", "f", *p, "g"]), (4, ["h", *p, "i", "j"])]
    found = passages(frame_of(spark, [(k, " ".join(w)) for k, w in rows])).collect()
    assert [tuple(r)[:7] for r in found] == [(4, 1, 71, 3, 2, 72, 70)]


def test_copies_give_a_row_each(spark):
    rng = np.random.default_rng(8)
    text = [f"t{i}" for i in range(300)]
    rows = [(k, " ".join(w if rng.random() > 0.03 else f"n{k}x{i}" for i, w in enumerate(text))) for k in range(200)]
    found = passages(frame_of(spark, rows)).groupBy("doc_id").count().collect()
    assert len(found) == 199 and max(r["count"] for r in found) <= 4


def test_repeated_rows_and_ids(spark):
    shared, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    rows = [(1, f"{shared} a"), (2, f"b {shared}"), (2, f"b {shared}"), (None, shared), (None, shared), (3, None), (4, ""), (5, " \n")]
    frame = frame_of(spark, rows)
    found = passages(frame)
    assert [tuple(r)[:4] for r in found.collect()] == [(2, 1, 61, 1)]
    left = cut(frame, found)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in left.collect()) == [(0, shared), (0, shared), (1, f"{shared} a"), (2, "b"), (2, "b"), (3, ""), (4, ""), (5, "")]
    frame = frame_of(spark, [(1, shared), (2, f"b {shared}"), (2, other)])  # the least text stands for the id
    assert sorted((r.doc_id, r.text.strip()) for r in cut(frame, passages(frame)).collect()) == [(1, shared), (2, "b"), (2, other)]
    assert passages(frame.limit(0)).count() == 0 and cut(frame, passages(frame.limit(0))).count() == 3


def test_very_long_texts(spark):
    long = " ".join(f"l{i}" for i in range(200_000))
    found = passages(frame_of(spark, [(1, long), (2, f"x {long}"), (3, "one word " * 100_000), (4, "w" * 3_000_000)])).collect()
    assert [tuple(r)[:7] for r in found] == [(2, 1, 200_001, 1, 0, 200_000, 200_000)]


def test_ranges_that_cut_a_common_seed(spark):
    """A passage that all documents have is linked across the ranges that its seeds are dealt to."""
    shared = " ".join(f"p{i}" for i in range(55))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = passages(frame_of(spark, [(k, f"own{k} {shared} end{k}") for k in range(300)])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.doc_id, r.start, r.end) for r in found) == [(k, 1, 56) for k in range(1, 300)]


def test_chains_are_the_best_ones():
    """The tree finds the scores of trying every match before each."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 25))
        pairs = sorted({(10 * int(p), 10 * int(s)) for p, s in rng.integers(0, 40, size=(n, 2))})  # no two overlap
        place, source = [p for p, _ in pairs], [s for _, s in pairs]
        k, cost = substring_dedup.K, substring_dedup.GAP_COST
        gain = lambda score, i, j: score - cost * (place[j] + source[j] - place[i] - source[i] - 2 * k)
        best = []
        for j in range(len(pairs)):
            best.append(k + max([0.0, *(gain(best[i], i, j) for i in range(j) if place[i] < place[j] and source[i] < source[j])]))
        chain = substring_dedup.chains(place, source)[0]
        assert all(place[a] < place[b] and source[a] < source[b] for a, b in zip(chain, chain[1:]))
        score = float(k)
        for a, b in zip(chain, chain[1:]):
            score = k + gain(score, a, b)
        assert score == pytest.approx(max(best))


def test_occurrences_meet_by_rank():
    """Rows do not depend on how occurrences come in batches, and are those of plain loops."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        rows = sorted({(int(k), int(d), int(p)) for k, d, p in zip(rng.integers(0, 4, 60), rng.integers(0, 6, 60), rng.integers(0, 50, 60))})
        want = []
        for key in {k for k, _, _ in rows}:
            by_doc = {}
            for k, d, p in rows:
                if k == key:
                    by_doc.setdefault(d, []).append(p)
            order = sorted(by_doc)
            for i, d in enumerate(order):
                for r, p in enumerate(by_doc[d]):
                    first, before = by_doc[order[0]], by_doc[order[i - 1]]
                    if i or len(order) > 1:
                        want.append((key, d, p, order[0], first[r % len(first)] if i else p, *((order[i - 1], before[r % len(before)]) if i else (None, None))))
        for step in (1, 2, 7, 100):
            got, held, done = [], [np.zeros(0, dtype=np.int64)] * 3, 0
            for lo in [*range(0, len(rows), step), None]:
                some = np.array(rows[lo : lo + step], dtype=np.int64).reshape(-1, 3).T if lo is not None else np.zeros((3, 0), dtype=np.int64)
                columns = [np.concatenate(x) for x in zip(held, some)]
                out, rest, n_done = substring_dedup._linked(*columns, done, lo is None)
                got += [(*map(int, r[:5]), *(map(int, r[5:7]) if r[7] else (None, None))) for r in zip(*out)]
                held, done = [c[rest] for c in columns], n_done
            assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repetitive_texts_are_one_passage(spark):
    period = [f"p{i}" for i in range(31)]
    rows = [(k, " ".join([f"a{k}", *period * 8, f"b{k}"])) for k in range(40)] + [(100 + k, " ".join(["x", "y"] * (100 + k))) for k in range(30)]
    found = passages(frame_of(spark, rows)).collect()
    whole = {r.doc_id: (r.start, r.end) for r in found if r.start <= 1}
    assert whole == {k: (1, 249) for k in range(1, 40)} | {k: (0, 2 * k - 2) for k in range(101, 130)} and len(found) <= 2 * len(whole)


def found_share(spark, pairs):
    """Of each pair (earlier document, later one, first and last word of a passage in it), the share of its words that is found."""
    rows = [(2 * i + j, " ".join(p[j])) for i, p in enumerate(pairs) for j in (0, 1)]
    masks = {2 * i + 1: np.zeros(len(p[1]), dtype=bool) for i, p in enumerate(pairs)}
    for r in passages(frame_of(spark, rows)).collect():
        masks[r.doc_id][r.start : r.end] = True
    return np.array([masks[2 * i + 1][a:b].mean() for i, (_, _, a, b) in enumerate(pairs)])


def test_passages_whose_blocks_stand_elsewhere(spark):
    """Blocks of a passage that both documents have elsewhere too, in other orders, do not cut it short."""
    rng = np.random.default_rng(31)
    own = lambda k: [f"w{x}" for x in rng.integers(1 << 40, size=k)]
    pairs = []
    for i in range(60):
        whole, n = own(int(rng.integers(88, 121))), 3 + i % 3
        edges = np.linspace(0, len(whole), n + 1).astype(int)
        both = []
        for _ in range(2):
            parts = [whole[edges[b] : edges[b + 1]] for b in rng.permutation(n)]
            at, words = int(rng.integers(0, n + 1)), []
            for k, part in enumerate([*parts[:at], whole, *parts[at:]]):
                words += own(int(rng.integers(20, 60)))
                place = len(words) if k == at else place if k else 0
                words += part
            both.append((words, place))
        pairs.append((both[0][0], both[1][0], both[1][1], both[1][1] + len(whole)))
    assert (found_share(spark, pairs) == 1).all()


@pytest.mark.parametrize(("n", "equal", "least"), [(100, 0.85, 0.7), (100, 0.9, 0.9), (500, 0.8, 0.7), (500, 0.85, 0.9)])
def test_fuzzy_passages(spark, n, equal, least):
    """Share of passages with ``equal`` of their words unchanged of which 80 % is found."""
    rng = np.random.default_rng(n)
    own = lambda k: [f"w{x}" for x in rng.integers(1 << 40, size=k)]
    pairs = []
    for _ in range(60):
        one = own(n)
        other = [w if rng.random() < equal else own(1)[0] for w in one]
        pairs.append(([*own(90), *one, *own(70)], [*own(80), *other, *own(60)], 80, 80 + n))
    assert (found_share(spark, pairs) >= 0.8).mean() >= least
