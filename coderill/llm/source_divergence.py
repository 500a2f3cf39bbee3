"""How the words of each source differ from those of the other sources of its language.

Terms are maximal runs of A-Z, a-z and all characters beyond ASCII, with A-Z lower-cased. A language keeps the terms
that are in enough of its documents. Counting has two passes over the texts:

1. Every task adds the document frequencies of its (language, term) pairs to a count-min sketch. Sketches are merged
   slice by slice, and never underestimate, so a pair whose least cell is below the bound can be none that is kept.
   Cells stop at the bound, as only reaching it matters; what is left of a sketch is one bit for each cell.
2. Every task counts its terms by (language, source, term), and sends those that the sketch allows. These are counted
   exactly, and the kept ones are chosen by their exact document frequency.

The sketch has the same size for every input (``WIDTH`` cells in each of ``DEPTH`` rows, 2 MB of bits), so its bits go to all
tasks. In a corpus with many more pairs than cells it discards little, and the second pass sends more; the
result is the same.

The value of a pair of sources is a sum over all kept terms of the language, of which most have no count in one or
both. It is the sum as if no term had a count, corrected for the terms that one source has (by the histogram of its
counts), and for the terms that both have (a join on language and term, with a row for each two sources that share a
term; pairs of sources are the result, so their number is its size).

Null texts, languages and sources count as empty ones. Rows count as often as they come. A source without terms, or of a
language that keeps none, has its pairs and no terms. Of an empty table nothing is returned. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coderill.llm.tables import materialise
from coderill.llm.worker import tidy

MIN_DOCS = 10
TOP = 10
WIDTH = 1 << 22
DEPTH = 4
_SLICE = 1 << 18
#: Entries of a task's tables from which on they are handed over.
_MOST = 1 << 19
#: Sources in all up to which their table goes to all tasks.
FEW_GROUPS = 10_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_LETTERS).split()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[bytes]]]:
    for batch in batches:
        lang, source, text = (batch.column(k) for k in range(3))
        for k in range(batch.num_rows):
            yield lang[k].as_py(), source[k].as_py(), terms(text[k].as_py())


def _cells(lang: str, found: list[bytes], width: int, depth: int) -> np.ndarray:
    """The cell of each term in each row of the sketch, rows one after another: (depth, terms)."""
    seed = zlib.crc32(lang.encode())
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t, seed) for t in found]), dtype=np.uint64).reshape(-1, 2)
    row = np.arange(depth, dtype=np.uint64)[:, None]
    return ((digest[:, 0] + row * (digest[:, 1] | np.uint64(1))) % np.uint64(width) + row * np.uint64(width)).astype(np.int64)


def _add(sketch: np.ndarray, cells: np.ndarray, n: np.ndarray, bound: int) -> None:
    """Add ``n`` to each term's cells, up to the bound."""
    for row in cells:
        at, where = np.unique(row, return_inverse=True)
        sketch[at] = np.minimum(sketch[at] + np.bincount(where, weights=np.minimum(n, bound)), bound)


SLICE = "slice int, part int, cells binary"


def _sketched(batches: Iterator[pa.RecordBatch], width: int, depth: int, bound: int) -> Iterator[pa.RecordBatch]:
    sketch, held = np.zeros(width * depth, dtype=np.uint8), {}

    def flush() -> None:
        for lang, df in held.items():
            _add(sketch, _cells(lang, list(df), width, depth), np.fromiter(df.values(), dtype=np.int64, count=len(df)), bound)
        held.clear()

    for k, (lang, _, found) in enumerate(_groups(batches)):
        if found:
            held.setdefault(lang, Counter()).update(set(found))
        if k % 64 == 0 and sum(map(len, held.values())) > _MOST:
            flush()
    flush()
    size = min(_SLICE, width)
    part = int.from_bytes(xxhash.xxh3_64_digest(sketch.tobytes())[:3], "big")  # any number that spreads tasks
    rows = [(k, sketch[k * size : (k + 1) * size]) for k in range(len(sketch) // size)]
    rows = [(k, pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for k, x in rows if x.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["slice", "part", "cells"])


def _merged(table: pa.Table, size: int, bound: int) -> np.ndarray:
    total = np.zeros(size, dtype=np.uint16)
    for x in table["cells"].to_pylist():
        total = np.minimum(total + np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), dtype=np.uint8), bound).astype(np.uint16)
    return total.astype(np.uint8)


def sketch(texts: DataFrame, width: int = WIDTH, depth: int = DEPTH, bound: int = MIN_DOCS) -> np.ndarray:
    """For every cell of the merged sketch of (lang, source, text), whether it reaches the bound; ``width`` is a power of two."""
    size = min(_SLICE, width)
    slices = texts.mapInArrow(tidy(lambda batches: _sketched(batches, width, depth, bound)), SLICE)

    def some(table: pa.Table) -> pa.Table:
        packed = pa.compress(_merged(table, size, bound).tobytes(), codec="zstd", asbytes=True)
        return pa.table({"slice": table["slice"][:1], "part": table["part"][:1], "cells": pa.array([packed], pa.binary())})

    def reached(table: pa.Table) -> pa.Table:
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([np.packbits(_merged(table, size, bound) >= bound).tobytes()], pa.binary())})

    half = slices.groupBy("slice", (F.col("part") % 16).alias("some")).applyInArrow(lambda _, t: some(t), SLICE)
    rows = half.groupBy("slice").applyInArrow(reached, "slice int, bits binary").collect()  # width * depth bits
    out = np.zeros(width * depth, dtype=bool)
    for r in rows:
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))[:size]
    return out


COUNTS = "lang string, source string, term string, n long, df long"


def _counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray, width: int, depth: int) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            every = list(n)
            cells = _cells(lang, every, width, depth)
            bit = np.unpackbits(bits[cells >> 3][..., None], axis=-1)[np.arange(depth)[:, None], np.arange(len(every)), cells & 7]
            found = [every[k] for k in np.flatnonzero(bit.all(axis=0))]
            columns = [[lang] * len(found), [source] * len(found), [t.decode(errors="replace") for t in found]]
            numbers = [[n[t] for t in found], [df[t] for t in found]]
            if found:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), *(pa.array(c, pa.int64()) for c in numbers)], names=["lang", "source", "term", "n", "df"])
        held.clear()

    for k, (lang, source, found) in enumerate(_groups(batches)):
        if found:
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(found)
            df.update(set(found))
        if k % 64 == 0 and sum(len(n) for n, _ in held.values()) > _MOST:
            yield from flush()
    yield from flush()


def counts(texts: DataFrame, bits: np.ndarray, width: int = WIDTH, depth: int = DEPTH, least: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, in_lang, first) of kept terms where a source has them.

    ``in_lang`` is the term's count in the language; ``first`` holds on one row of each term of a language.
    """
    packed = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))  # width * depth bits, whatever the input
    rows = texts.mapInArrow(tidy(lambda batches: _counted(batches, packed.value, width, depth)), COUNTS)
    exact = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    exact = exact.select("*", F.sum("n").over(term).alias("in_lang"), F.sum("df").over(term).alias("in_docs"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return exact.filter(F.col("in_docs") >= least).drop("df", "in_docs")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact; of no kept terms, 1."""
    whole = F.lit(1_000_000_000).cast("decimal(18,0)") * (n + 2).cast("decimal(20,0)")
    return F.when(kept == 0, F.lit(1).cast("long")).otherwise(1 + F.call_function("div", whole, (total + 2 * kept).cast("decimal(38,0)")).cast("long"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", width: int = WIDTH, depth: int = DEPTH, least: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the ``top`` terms that a source has more often than its language."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    texts = plain.select("lang", "source", F.col("text").cast("binary").alias("text"))
    kept = materialise(counts(texts, sketch(texts, width, depth, least), width, depth, least))
    per_lang = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum(F.when(F.col("first"), F.col("in_lang"))).alias("lang_total"))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = plain.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("v"), zero("lang_total"))
    groups = materialise(groups.withColumn("none", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    few = groups.count() <= FEW_GROUPS
    small = lambda frame: F.broadcast(frame) if few else frame

    cells = kept.join(small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    best = cells.withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("v"))).filter("p > q")
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    side = lambda frame, x, *columns: frame.select("lang", *(F.col(c).alias(f"{x}_{c}") for c in columns))
    two = side(groups, "a", "source", "none").join(small(side(groups, "b", "source", "none")), "lang").filter("a_source <> b_source")
    neither = apart(F.col("a_none"), F.col("b_none"))
    base = two.join(small(groups.select("lang", F.col("source").alias("a_source"), "v")), ["lang", "a_source"]).select("lang", "a_source", "b_source", (F.col("v") * neither).alias("value"))
    # terms that the first source has, as if the second had none; both ways round, as pairs are listed both ways
    bars = cells.groupBy("lang", "source", "none", "p").agg(F.count(F.lit(1)).alias("m"))
    one = side(bars, "a", "source", "none", "p", "m").join(small(side(groups, "b", "source", "none")), "lang").filter("a_source <> b_source")
    one = one.select("lang", "a_source", "b_source", (F.col("a_m") * (apart(F.col("a_p"), F.col("b_none")) - neither)).alias("value"))
    one = one.groupBy("lang", "a_source", "b_source").agg(F.sum("value").alias("value"))
    other = one.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), "value")
    # terms that both have
    left, right = (cells.select("lang", "term", *(F.col(c).alias(f"{x}_{c}") for c in ("source", "none", "p"))) for x in "ab")
    both = left.join(right, ["lang", "term"]).filter("a_source < b_source")
    extra = apart(F.col("a_p"), F.col("b_p")) - apart(F.col("a_p"), F.col("b_none")) - apart(F.col("a_none"), F.col("b_p")) + neither
    both = both.groupBy("lang", "a_source", "b_source").agg(F.sum(extra).alias("value"))
    back = both.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), "value")
    pairs = base.unionByName(one).unionByName(other).unionByName(both).unionByName(back).groupBy("lang", "a_source", "b_source").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(best).filter(F.col("rank") <= top))


def audit_sql(least: int = MIN_DOCS, top: int = TOP) -> str:
    """The same for all of ``documents`` in DuckDB, over every pair of sources and every kept term."""
    share = lambda c, n: f"1 + (CAST(1000000000 AS HUGEINT) * ({c} + 2)) // ({n} + 2 * v)"
    apart = "CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)"
    return rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(ts)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= {least}),
c AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS t FROM d) SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
vs AS (SELECT g.lang, coalesce(k.v, 0) AS v FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k USING (lang)),
tot AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
lang_c AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY lang, t),
lang_tot AS (SELECT lang, sum(n) AS total FROM lang_c GROUP BY lang),
p AS (
  SELECT grp.lang, grp.source, kept.t, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 'coalesce(tot.total, 0)')} AS p
  FROM grp JOIN vs USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, t) LEFT JOIN tot USING (lang, source)),
q AS (SELECT lang_c.lang, t, {share('n', 'total')} AS q FROM lang_c JOIN lang_tot USING (lang) JOIN vs USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum({apart}) FROM (SELECT x.p AS p, y.p AS q FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, {apart} AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
