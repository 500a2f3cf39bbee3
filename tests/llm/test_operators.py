"""Small cases of each operator: nulls, empty and odd texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coderill.llm import bpe, decision_rules, deleted_interpolation, embedding_dedup, html_templates, license_scan, packing, quality_lm, shingle_join, substring_dedup, words
from coderill.llm.graph import components
from coderill.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, class string, shared string, chunk int"
PROSE = " ".join(f"w{i % 97}x{i % 13} and" for i in range(120))


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "x", "y", 1) for k, t in texts], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, PROSE), (5, PROSE), (6, PROSE + " tail end"), (None, PROSE), (None, None), (7, "é ü " * 50), (8, "a b c d")]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (7, 9), (5, 4), (2, 1)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {3: 3, 4: 3, 5: 3, 7: 7, 8: 7, 9: 7, 1: 1, 2: 1}
    assert components(edges.limit(0)).count() == 0


def test_words_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a bb", None, "ccc dd\tE e", "", "x" * 40 + " y z", " lead"])
    whole = [list(map(int, np.concatenate([w.hashes for w in words.split_words(texts)])))]
    monkeypatch.setattr(words, "BLOCK", 8)
    assert whole == [list(map(int, np.concatenate([w.hashes for w in words.split_words(texts)])))]


def jaccard_truth(rows, n=5):
    sets = {}
    for k, t in rows:
        w = [x for x in words_of(t)]
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    return {k: (len(s), label[k]) for k, s in sets.items()}


def words_of(text):
    import re

    return [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]


@pytest.mark.parametrize("block", [3, 4096])
def test_shingle_join(spark, block):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B")]
    for k in range(10, 34):
        copy = list(base)
        for at in rng.integers(0, 60, size=k % 3):
            copy[at] = f"new{k}"
        rows.append((k, " ".join(copy)))
    got = shingle_join.join(docs(spark, rows + [rows[-1], (None, "x y")]), block=block).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == jaccard_truth(rows)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    assert shingle_join.join(docs(spark, rows[:0])).count() == 0


def test_passages(spark):
    shared = " ".join(f"p{i}" for i in range(70))
    fuzzy = " ".join(f"p{i}" if i % 20 else "odd" for i in range(70))
    rows = [(1, "start one " + shared + " end one"), (2, shared.upper() + " x"), (3, "q " + fuzzy), (4, " ".join(f"p{i}" for i in range(30))), (5, None), (None, shared), (6, "")]
    frame = docs(spark, rows)
    found = {r.doc_id: (r.start, r.end, r.source_id) for r in substring_dedup.passages(frame).collect()}
    assert found[2] == (0, 70, 1) and found[3][2] == 1 and found[3][1] == 71 and set(found) == {2, 3}
    left = {r.doc_id: r.text for r in substring_dedup.cut(frame, substring_dedup.passages(frame)).collect()}
    assert left[1] == rows[0][1] and left[2] == "x" and left[4] == rows[3][1] and left[6] == "" and left[5] is None
    assert substring_dedup.passages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("gap", [60, 100, 200, 500])
def test_passages_with_unlike_words_between(spark, gap):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(k, " ".join([one, *(f"u{k}x{i}" for i in range(gap + more)), two])) for k, more in ((1, 0), (2, 0), (3, 17))]
    found = sorted((r.doc_id, r.start, r.end, r.n_equal) for r in substring_dedup.passages(docs(spark, rows)).collect())
    assert found == [(2, 0, 60, 60), (2, 60 + gap, 120 + gap, 60), (3, 0, 60, 60), (3, 77 + gap, 137 + gap, 60)]


def test_passages_of_stretches_that_others_have_apart(spark):
    rows = []
    for k in range(0, 300, 5):
        one, two = (" ".join(f"{c}{k}x{i}" for i in range(30)) for c in "pq")
        rows += [(k, f"a{k} {one} b{k}"), (k + 1, f"c{k} {two} d{k}"), (k + 2, f"e{k} {one} {two} f{k}"), (k + 3, f"g{k} {one} {two} h{k}")]
    found = sorted((r.doc_id, r.start, r.end, r.source_id) for r in substring_dedup.passages(docs(spark, rows)).collect())
    assert found == [(k + 3, 1, 61, k + 2) for k in range(0, 300, 5)]


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    rows = [(k, [float(x) for x in centres[k % 20] + 0.08 * rng.normal(size=8)]) for k in range(120)]
    rows += [(200, rows[0][1]), (201, [2 * x for x in rows[0][1]]), (202, None), (203, [0.0] * 8), (204, [float("nan")] * 8), (205, [1.0, None] * 4), (206, [1.0, 2.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), interval=16).collect()
    fine = {k: np.array(np.float32(v), dtype=float) for k, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in fine.items()}
    links = {a: {b for b in unit if b != a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95} for a in unit}
    label = {k: k for k, _ in rows}
    for _ in rows:
        for a in links:
            label[a] = min([label[a], *(label[b] for b in links[a])])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (len(links.get(k, ())), label[k], label[k] == k) for k, _ in rows}


def test_pages(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav><div class='ad'>buy</div>{}<footer>f</footer></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(f"<article><h1>Title {k}</h1><p>one &amp;\n two<p>three<div class='comments'>no</div></article>")) for k in range(5)]
    rows += [(6, None, None), (7, "http://other.example", ""), (8, "x", "plain &lt; text"), (9, None, "<p>only<br>this")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("Title 3\none & two\nthree", 23)
    assert got[6] == got[7] == ("", 0) and got[8][0] == "plain < text" and got[9][0] == "only\nthis"


def extracted(spark, page):
    rows = [(k, f"http://h.example/{k}", page.replace("#", str(k))) for k in range(5)]
    return html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("page_id = 3").first().text


def test_regions_leave_nothing_out(spark):
    long = "word " * 60
    sections = "".join(f"<section><h2>Part {i}</h2><p>{long}{i}</p></section>" for i in range(3))
    got = extracted(spark, f"<html><body><nav>menu</nav><article><h1>Title #</h1><p>start</p>{sections}</article><footer>f</footer></body></html>")
    assert got.split("\n") == ["Title 3", "start", *(x for i in range(3) for x in (f"Part {i}", f"{long}{i}"))]
    got = extracted(spark, f"<html><body><article><h1>Title #</h1><p class='lead'>{long}</p><div class='body'><p>{long * 2}end</p></div></article></body></html>")
    assert got.split("\n") == ["Title 3", long.strip(), f"{long * 2}end"]
    got = extracted(spark, f"<html><body><h1>T</h1><div class='body'><p>{long * 20}</p></div></body></html>")
    assert got.startswith("T\nword")
    assert extracted(spark, f"<html><body>\n<h1>T</h1>\n<div class='body'><p>{long * 20}</p></div>").startswith("T\nword")
    assert html_templates.main_text(f"<body><article>a</article><article>b</article><p>{long}") == "a\nb\n" + long.strip()


@pytest.mark.parametrize(
    "page",
    [
        "<body class='post has-sidebar'>{}</body>",
        "<html><body class='has-sidebar'><article class='post'>{}</article></body></html>",
        "<body><div class='content with-sidebar'>{}</div><div class='site-footer'>f</div><div class='ad'>buy</div></body>",
        "<body><form id='search'>{}</form></body>",
        "<body><div role='banner'><article class='widget'>{}</article></div></body>",
        "<body><article>{}</article><div class='comments'>%s</div></body>" % ("reply " * 90),
    ],
)
def test_furniture_is_not_the_article(spark, page):
    inside = "<h1>T</h1><p>text of it</p><div class='search-results'>two found</div><div class='share-price'>12.5</div><div class='share-buttons'>s</div>"
    assert html_templates.main_text(page.format(inside)) == "T\ntext of it\ntwo found\n12.5"
    assert extracted(spark, page.format(inside)) == "T\ntext of it\ntwo found\n12.5"


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, (20, "it's  three   spaces\n\n x<|endoftext|>y 123"), (21, "ab" * 400), (22, "  nbsp 日本 🙂!!")]
    got = bpe.round_trip(docs(spark, texts), path).collect()
    want = []
    for k, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    frame = docs(spark, texts[-3:])
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame, path), path).collect()} == dict(texts[-3:])


def test_words_are_encoded_as_by_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), packing.WordIds(path)
    monkeypatch.setattr(packing, "MEMORY", 20)
    texts = ["Don't stop, it's (fine). x<|endoftext|>y <|endoftext|> a<|endoftext|>", "\u0130stanbul \u039f\u0394\u039f\u03a3. \u03a3, e\u0301t\u00e9!! e\u0301 \u65e5\u672c; \u00bdx ab12. _a_ '' a' --- \u1e9e\u00df?", "one, One. ONE one two two;; ***,three.", "", "\u01c5. \u0301a a\u200b. \u0e01\u0e33: \uac00\u11a8, \U0001f642!"]
    texts += [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}o{'.,;!'[k % 4]}" for k in range(60)), *texts[:3]]
    for some in (texts[:2], texts[2:], texts):
        assert ours.encode(some) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, (30, "word " * 9000), *((100 + k, "word " * (k * 97 % 1900)) for k in range(60))]
    got = packing.pack(packing.tokenise(docs(spark, texts), path)).collect()
    want = []
    for k, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(k, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes())) for i in range(0, len(ids), 4096)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(w[3] for w in want) // 4096) + 1


@pytest.mark.parametrize("seed", range(5))
def test_plans_hold_every_item(seed):
    rng = np.random.default_rng(seed)
    sizes = {int(s): int(rng.integers(1, 40)) for s in rng.integers(1, 101, size=30)}
    plan = packing.Plan(sizes, 100)
    filled = {}
    size, rank, first, each, offset = plan.arrays()
    for s, n in sizes.items():
        runs = [k for k in range(len(size)) if size[k] == s]
        for r in range(n):
            k = max(k for k in runs if rank[k] <= r)
            at = r - rank[k]
            filled.setdefault(int(first[k] + at // each[k]), []).append((int(offset[k] + at % each[k] * s), s))
    assert len(filled) == plan.bins
    for parts in filled.values():
        at = 0
        for o, s in sorted(parts):
            assert o == at
            at += s
        assert at <= 100


def test_scores(spark):
    rows = [*ODD, *((40 + k, f"The cat sat on mat {k % 5} the cat") for k in range(30))]
    got = deleted_interpolation.score(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    counts, held = {}, lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    for k, t in rows:
        if not held(k):
            for w in [*words_of(t), None]:
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = {}
    for k, t in rows:
        tokens = [*words_of(t), None]
        want.setdefault(k, []).append((held(k), len(tokens), sum(w in counts for w in tokens), total, sum(np.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in tokens)))
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-9 * max(1, abs(w[4])) for w in want[r.doc_id])
        assert r.score < 0


def test_weights_prefer_what_predicts():
    cells = np.array([5, 5]), np.array([90, 10]), np.array([0.5, 0.0]), np.array([0.01, 0.01])
    weights = deleted_interpolation.learn_weights(*cells, 1e-4)
    assert weights[5, 0] > 0.8 and np.allclose(weights.sum(axis=1), 1)


def test_rules(spark):
    good = [(400 + k, " ".join(f"word{k}n{i}" for i in range(30))) for k in range(40)]
    bad = [(100 + k, " ".join(f"w{k}n{i}###" for i in range(30))) for k in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad] + [(None, 0, 0), (1000, None, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [*good, *bad, *ODD, (300, "a b c d e f g h i j\n" * 3)])
    rules = decision_rules.fit(frame, labels)
    judged = decision_rules.judge(frame, rules).collect()
    got = {r.doc_id: r for r in judged}
    assert all(got[k].kept for k, _ in good) and not any(got[k].kept for k, _ in bad)
    assert tuple(got[300])[1:7] == (30, 30, 0, 2, 30, True)
    assert got[1].n_words == 0 and got[1].base_failed
    kept = decision_rules.accepted(frame, rules)
    assert kept.columns == frame.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in judged if r.kept)
    assert decision_rules.fit(frame, labels.limit(0)).rules == []


def test_licenses(spark):
    rows = [*ODD, (50, "text before\nLicensed under the Apache License, Version 2.0.\nafter"), (51, "released under the mit license"), (52, "Released under no license at all by anyone")]
    got = license_scan.scan(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.unit, r.license) for r in got if r.unit >= 0) == [(50, 0, "Apache-2.0"), (50, 2, "Apache-2.0"), (51, 1, "MIT")]
    assert {(r.doc_id, r.license) for r in got if r.unit < 0} == {(50, "Apache-2.0")}  # windows


def test_quality_model(spark):
    rng = np.random.default_rng(1)
    common = [f"{a}{b}" for a in "abcdefgh" for b in "aeiou"]
    good = [(k, " ".join(rng.choice(common, size=60)).capitalize() + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(f"{w.upper()}!!" for w in rng.choice(common, size=60))) for k in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good], "doc_id long, quality int, toxic int")
    frame = docs(spark, [*good, *bad, (2000, None), (2001, "")])
    classifier = quality_lm.fit(frame, labels)
    got = {r.doc_id: r.kept for r in quality_lm.judge(frame, classifier).collect()}
    assert sum(got[k] for k, _ in good) >= 299 and not any(got[k] for k, _ in bad) and got[2000] and got[2001]
    assert quality_lm.judge(frame, quality_lm.fit(frame, labels.limit(0))).filter(~F.col("kept")).count() == 0


def test_model_sums_to_one(spark):
    frame = docs(spark, [(k, "a b a c a b d " * 5) for k in range(4)])
    vocabulary_words = quality_lm.vocabulary_of(frame, least=1)
    model = quality_lm.train(frame, vocabulary_words)
    stream, _ = quality_lm.streams(np.concatenate(([vocabulary_words[0]], [quality_lm._END])), np.array([2]))
    total = 0.0
    for token in [*vocabulary_words, quality_lm._END, np.uint64(12345)]:  # the last is any unknown token
        stream[4] = token
        total += float(np.exp(model.log_probabilities(stream)[4]))
    assert total == pytest.approx(1)
