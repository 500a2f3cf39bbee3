"""op11 against definitions: the collection, the cut into segments, and whole tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from coderill.llm import queries, suffix_dedup

SCHEMA = "doc_id long, text string, n long, chunk int, d string, anchor string"


def truth(rows, length=200):
    """By definition, from every string of ``length`` bytes of all rows."""
    data = [(k, (t or "").encode()) for k, t in rows]
    n = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_collection_is_the_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(80):
        strings = [bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        index = suffix_dedup.Collection(strings, 5)
        # a mark of its own at each end, in order of the strings
        order = sorted((tuple(x + 1000 for x in s[i:]) + (k,), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        common = [0] + [next(p for p, (x, y) in enumerate(zip(a, b)) if x != y) for (a, *_), (b, *_) in zip(order, order[1:])]
        assert index.common.tolist() == [min(c, 5) for c in common]
        place = {(k, i): p for p, (_, k, i) in enumerate(order)}
        assert all(index.tails[place[k, i]] == place[k, i + 1] for k, s in enumerate(strings) for i in range(len(s)))
        n = Counter(s[i : i + 5] for s in strings for i in range(len(s) - 4))
        assert [list(map(bool, x)) for x in index.repeated()] == [[n[s[i : i + 5]] > 1 for i in range(len(s) - 4)] for s in strings]


@pytest.mark.parametrize("k", suffix_dedup.LEVELS)
def test_segments_hold_every_string_once_by_its_content(k):
    rng = random.Random(k)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(150, 900))) for _ in range(40)] + [b"ab" * 400, b"z" * 1000]
    texts += [texts[3] * 3 + texts[4], bytes(rng.choice(b"ab") for _ in range(suffix_dedup.BLOCK + 777))]
    seen, anchors = defaultdict(Counter), defaultdict(set)
    for number, start, starts, anchor, places in suffix_dedup.segments(texts, k):
        for a, s, x in zip(start.tolist(), starts.tolist(), anchor.tolist()):
            assert s <= suffix_dedup.LENGTH - k + 1
            seen[number].update(range(a, a + s))
            for p in range(a, a + s):
                anchors[texts[number][p : p + 200]].add(x)
    assert all(seen[i] == Counter(range(max(0, len(t) - 199))) for i, t in enumerate(texts))
    assert all(len(x) == 1 for x in anchors.values())


def odd_rows():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    bits = [text(rng.randint(100, 500)) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "ab" * 300), (4, "x" * 900), (4, "x" * 900), (5, "short"), (None, "ab" * 99 + "cd" + "ab" * 120), (None, None)]
    rows += [(6, "z" * 199), (7, "z" * 199), (8, "y" * 200), (9, "y" * 200), (10, "q" * 200), (11, text(suffix_dedup.BLOCK) * 2)]
    return rows + [(20 + i, "".join(rng.choice([*bits, text(rng.randint(1, 200))]) for _ in range(6))) for i in range(50)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_odd_rows(spark, monkeypatch, hot):
    """Also where nearly every anchor is cut anew."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 64)
    rows = odd_rows()
    frame = spark.createDataFrame([(k, t, 1, 2, "d", "a") for k, t in rows], SCHEMA).repartition(3)
    assert found(suffix_dedup.dedup(frame)) == truth(rows)


def test_passage_in_many_documents(spark, monkeypatch):
    """A passage too short to be cut, around which every document differs, and a longer one."""
    monkeypatch.setattr(suffix_dedup, "HOT", 16)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long = text(150), text(320)
    rows = [(i, text(250) + (short if i % 3 else long) + text(250)) for i in range(90)]
    assert found(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == truth(rows)


def test_empty_table(spark):
    frame = suffix_dedup.dedup(spark.createDataFrame([], SCHEMA))
    assert frame.collect() == [] and frame.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.QUERIES["op11_suffix_array_dedup"](spark, "/root/testdata/sf0.001")) == truth(rows)
