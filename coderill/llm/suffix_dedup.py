"""Bytes that lie in a string of 200 bytes which starts at another place too, by a column-wise suffix index.

A string of 200 bytes has the k-gram of least hash among those inside of it, its anchor, and equal strings have equal
anchors. So texts are cut into segments, runs of starts with one anchor and the 199 bytes after them; strings that start in
segments of different anchors are different, and each anchor can be looked at by itself.

1. Chunks of documents ask for the corpus-wide counts of their anchors (``exchange``), and keep the segments whose anchor
   occurs twice or more. These are written as a table, with the bytes of each text that are in any of them.
2. Segments are compared whole: where an equal one stands elsewhere, all of its strings are repeated. The others are left if
   their anchor has any other segment, or occurs twice inside of them.
3. Anchors are dealt to buckets with some thousands of different segments. A bucket's collection gets its Burrows-Wheeler
   transform and common prefixes column by column: each round inserts one more symbol of every segment, from the right,
   in one pass over the arrays of the round before (``Collection``). A start whose common prefix with a neighbour in the
   final order is 200 bytes or more is repeated.
4. An anchor with more than ``HOT`` different segments, as a passage of some dozens of bytes in a third of all documents has,
   is cut anew by longer k-grams, the last of which are the strings themselves; so no bucket is large.
5. The repeated spans return to the chunks, which cut their texts.

The sequential files of the method are tables and exchanges of Spark: a bucket's arrays are bounded and stay in memory.

Anchors are hashes of 47 bits; k-grams that share one meet needlessly, and no more. Segments of one anchor are told apart by
64 bits, and texts of one chunk by 128. A chunk follows from a row's id and text, and equal rows are packed before
they meet, so nothing depends on the order of rows. Null texts are empty. Rows return as often as they come, and a row that is
repeated has its strings elsewhere; null ids stay null. Of an empty table nothing is returned. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.llm import exchange
from coderill.llm.tables import materialise, shards, stage_folder
from coderill.llm.worker import tidy

LENGTH = 200
#: Lengths of the k-grams that anchor a string, in bytes, from level to level.
LEVELS = (64, 112, 160, 200)
#: Different segments of an anchor up to which they meet in a bucket, and of a bucket about.
HOT = 4096
BUCKET = 2048
BLOCK = 1 << 17

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOW = _U(BLOCK - 1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, base, dtype=np.uint64))))


_UP, _DOWN = _powers(_BASE, BLOCK + 2 * LENGTH), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 2 * LENGTH)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours."""
    if w == 1:
        return x
    n = len(x)
    rows = np.concatenate([x, np.full(-n % w, ~_U(0), dtype=np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def _cut(data: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Segments of texts of LENGTH bytes or more that follow one another from ``firsts`` on.

    Returns first start, number of starts, anchor, and number of places of the anchor.
    """
    n, w = len(data), LENGTH - k + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _UP[:n], out=sums[1:])
    g = (sums[k:] - sums[:-k]) * _DOWN[: n - k + 1]
    g ^= g >> _U(29)
    g *= _U(0xBF58476D1CE4E5B9)
    # the place in the low bits tells equal k-grams of one window apart, and the first of them counts
    m = _least((g & ~_LOW) | (np.arange(len(g), dtype=np.uint64) & _LOW), w)
    value = m & ~_LOW
    edge = np.zeros(len(m), dtype=bool)
    edge[1:] = value[1:] != value[:-1]
    edge[firsts] = True
    ends = np.append(firsts[1:], n) - LENGTH + 1
    edge[ends[:-1]] = True  # from here to the next text, strings cross texts
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, len(m)))
    if (sizes > w).any():  # an anchor that comes again and again: cut every w starts
        times = -(-sizes // w)
        starts = np.repeat(starts, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * w
        edge[starts] = True
        sizes = np.diff(np.append(starts, len(m)))
    moved = np.zeros(len(m) + 1, dtype=np.int64)
    np.cumsum((m[1:] != m[:-1]) & ~edge[1:], out=moved[2:])
    places = 1 + moved[starts + sizes] - moved[starts + 1]
    text = np.searchsorted(firsts, starts, side="right") - 1
    inside = starts < ends[text]
    return starts[inside], sizes[inside], value[starts[inside]], places[inside]


def segments(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of LENGTH bytes or more: its number, then start, number of starts, anchor and places of its segments."""
    group, size = [], 0
    for number, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > BLOCK:  # in pieces that hold every string once
            step = BLOCK - LENGTH + 1
            parts = [(lo, _cut(np.frombuffer(text[lo : lo + BLOCK], dtype=np.uint8), np.zeros(1, dtype=np.int64), k)) for lo in range(0, len(text) - LENGTH + 1, step)]
            yield number, np.concatenate([lo + p[0] for lo, p in parts]), *(np.concatenate([p[x] for _, p in parts]) for x in (1, 2, 3))
            continue
        if size + len(text) > BLOCK:
            yield from _together(texts, group, k)
            group, size = [], 0
        group.append(number)
        size += len(text)
    yield from _together(texts, group, k)


def _together(texts: list[bytes], group: list[int], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    if not group:
        return
    firsts = np.cumsum([0, *(len(texts[x]) for x in group)])
    start, *rest = _cut(np.frombuffer(b"".join([texts[x] for x in group]), dtype=np.uint8), firsts[:-1], k)
    at = np.searchsorted(start, firsts)
    for j, number in enumerate(group):
        lo, hi = at[j], at[j + 1]
        yield number, start[lo:hi] - firsts[j], *(x[lo:hi] for x in rest)


class Collection:
    """The suffixes of some strings in order, with their common prefixes and their Burrows-Wheeler transform.

    The transform is kept as the rising places of each symbol in it: ``tails`` has, for every suffix in order, the place of the
    suffix without the first symbol. Every string ends with a mark of its own, in order of the strings. Round t puts the suffixes
    of length t in their places: behind those with the same first symbol whose tails stand before its own. Its common prefix
    with a neighbour of the same first symbol is one more than the least between their tails.
    """

    def __init__(self, strings: list[bytes], most: int):
        used, flat = np.unique(np.frombuffer(b"".join(strings), dtype=np.uint8), return_inverse=True)
        n, self.flat, self.most = len(strings), flat, most
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.held = np.zeros(len(used), dtype=np.int64)  # suffixes by first symbol
        self.tails = np.zeros(n, dtype=np.int32)
        self.common = np.zeros(n, dtype=np.uint8 if most < 256 else np.uint16)
        places, ids = np.arange(n), np.flatnonzero(self.sizes > 0)
        places = places[ids]
        for t in range(1, int(self.sizes.max(initial=0)) + 1):
            places, ids = self._insert(places, ids, t)
            live = self.sizes[ids] > t
            places, ids = places[live], ids[live]

    def _insert(self, places: np.ndarray, ids: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Insert the suffixes of length t whose tails stand at ``places``, in rising order; returns their places and strings."""
        n, m = len(self.tails), len(places)
        c = self.flat[self.ends[ids] - t]
        order = np.argsort(c, kind="stable")  # by symbol, then by tail
        c, tail = c[order], places[order]
        edges = len(self.sizes) + np.concatenate(([0], np.cumsum(self.held)))
        cuts = np.searchsorted(c, np.arange(len(self.held) + 1))
        at = np.empty(m, dtype=np.int64)
        for x in np.flatnonzero(np.diff(cuts)):
            at[cuts[x] : cuts[x + 1]] = edges[x] + np.searchsorted(self.tails[edges[x] : edges[x + 1]], tail[cuts[x] : cuts[x + 1]])
        # neighbours: of the suffixes so far, and of the new ones
        before = np.where(at > edges[c], self.tails[np.maximum(at - 1, 0)], -1).astype(np.int64)
        after = np.where(at < edges[c + 1], self.tails[np.minimum(at, n - 1)], n).astype(np.int64)
        same = c[1:] == c[:-1]
        before[1:] = np.where(same, np.maximum(before[1:], tail[:-1]), before[1:])
        after[:-1] = np.where(same, np.minimum(after[:-1], tail[1:]), after[:-1])
        has_before, has_after = before >= 0, after < n
        asked = np.stack([np.where(has_before, before, tail - 1), tail, np.where(has_after, after, tail)], axis=1) + 1
        by_place = np.argsort(tail)  # so that little is read twice
        least = np.minimum.reduceat(np.concatenate([self.common, np.zeros(2, self.common.dtype)]), asked[by_place].ravel())
        first, second = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
        first[by_place], second[by_place] = least[::3], least[1::3]
        at += np.arange(m)
        stays = np.ones(n + m, dtype=bool)
        stays[at] = False
        moved = np.flatnonzero(stays).astype(np.int32)
        tails, common = np.empty(n + m, dtype=np.int32), np.empty(n + m, dtype=self.common.dtype)
        tails[stays], common[stays] = moved[self.tails], self.common
        tails[at] = moved[tail]
        common[at] = np.where(has_before, np.minimum(first + 1, self.most), 0)
        common[at[has_after] + 1] = np.minimum(second[has_after] + 1, self.most)
        self.tails, self.common = tails, common
        self.held += np.diff(cuts)
        return at, ids[order]

    def repeated(self) -> list[np.ndarray]:
        """For each string, from every start of ``most`` symbols, whether these start elsewhere too."""
        n, m = len(self.tails), len(self.sizes)
        long = self.common >= self.most
        found = long.copy()
        found[:-1] |= long[1:]
        step = np.zeros(n, dtype=np.int64)
        step[self.tails[m:]] = np.arange(m, n)
        out = [np.zeros(max(0, s - self.most + 1), dtype=bool) for s in self.sizes.tolist()]
        flat, firsts = np.zeros(sum(map(len, out)), dtype=bool), np.cumsum([0, *map(len, out)])
        places, ids = np.arange(m), np.arange(m)
        for t in range(1, int(self.sizes.max(initial=0)) + 1):
            live = self.sizes[ids] >= t
            places, ids = step[places[live]], ids[live]
            if t >= self.most:
                flat[firsts[ids] + self.sizes[ids] - t] = found[places]
        return [flat[a:b] for a, b in zip(firsts, firsts[1:])]


SPANS = "chunk int, d binary, start long, stop long"
SEGMENTS = "anchor long, h long, weight long, many boolean, chunk int, d binary, base long, start long, starts int, z binary, size long"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
_SEGMENTS = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in SEGMENTS.split(", "))])


def _rows(text: bytes, chunk: int, d: bytes, weight: int, start: np.ndarray, starts: np.ndarray, anchor: np.ndarray, places: np.ndarray, base: int = 0) -> pa.RecordBatch:
    """Segments of a text, or of its part from ``base`` on, as rows; the first has the bytes of all of them, with zeros elsewhere."""
    n, h, seen = len(start), [], bytearray(len(text))
    for a, s in zip(start.tolist(), starts.tolist()):
        seg = text[a : a + s + LENGTH - 1]
        h.append(xxhash.xxh3_64_intdigest(seg))
        seen[a : a + len(seg)] = seg
    z = [pa.compress(bytes(seen), codec="zstd", asbytes=True)] + [None] * (n - 1)
    columns = [anchor.view(np.int64), np.array(h, dtype=np.uint64).view(np.int64), np.full(n, weight), places > 1, np.full(n, chunk), [d] * n, np.full(n, base), start + base, starts, z, np.full(n, len(text))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else pa.array(c).cast(f.type) for c, f in zip(columns, _SEGMENTS)], schema=_SEGMENTS)


OPEN = "anchor long, n long, others long, chunk int, d binary, start long, seg binary"
_OPEN = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in OPEN.split(", "))])


def _fetched(texts: pa.Table, asked: pa.Table) -> pa.Table:
    """Segments of a chunk with their bytes."""
    wanted = set(zip(asked["d"].to_pylist(), asked["base"].to_pylist()))
    held = {}
    for d, base, z, size in zip(*(texts[c].to_pylist() for c in ("d", "base", "z", "size"))):
        if (d, base) in wanted:
            held[d, base] = pa.decompress(z, size, codec="zstd", asbytes=True)
    segs = [held[d, base][a - base : a - base + n + LENGTH - 1] for d, base, a, n in zip(*(asked[c].to_pylist() for c in ("d", "base", "start", "starts")))]
    return pa.table({**{f.name: asked[f.name].cast(f.type) for f in _OPEN if f.name != "seg"}, "seg": pa.array(segs, pa.binary())}).select(_OPEN.names)


def _distinct(table: pa.Table) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """The different texts of a chunk, with their keys and numbers of rows."""
    held: dict[bytes, list] = {}
    for d, n, z, size in zip(*(table[c].to_pylist() for c in ("d", "n", "z", "size"))):
        if d in held:
            held[d][1] += n
        else:
            held[d] = [pa.decompress(z, size, codec="zstd", asbytes=True) if size else b"", n]
    return list(held), [t for t, _ in held.values()], np.array([n for _, n in held.values()], dtype=np.int64)


def _asked(table: pa.Table, chunks: int) -> pa.Table:
    _, texts, weights = _distinct(table)
    found = [(anchor, places * weights[k]) for k, _, _, anchor, places in segments(texts, LEVELS[0])]
    if not found:
        return exchange.requests(table["chunk"][0].as_py(), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), chunks)
    keys, at = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)
    return exchange.requests(table["chunk"][0].as_py(), keys, counts, chunks)


def _kept(table: pa.Table, answers: pa.Table, chunks: int) -> pa.Table:
    """Segments of a chunk whose anchors occur twice or more."""
    if not table.num_rows:
        return _SEGMENTS.empty_table()
    chunk, (keys, texts, weights) = table["chunk"][0].as_py(), _distinct(table)
    found = list(segments(texts, LEVELS[0]))
    if not found:
        return _SEGMENTS.empty_table()
    distinct, at = np.unique(np.concatenate([f[3] for f in found]), return_inverse=True)
    often = exchange.answered(answers, distinct, chunks)[at] > 1
    out, lo = [], 0
    for k, start, starts, anchor, places in found:
        keep = often[lo : lo + len(start)]
        lo += len(start)
        if keep.any():
            out.append(_rows(texts[k], chunk, keys[k], int(weights[k]), start[keep], starts[keep], anchor[keep], places[keep]))
    return pa.Table.from_batches(out, schema=_SEGMENTS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, chunk, d, n, z, size): compressed texts; equal rows of a batch are one with their number."""
    for batch in batches:
        held: dict[tuple, list] = {}
        for k, data in enumerate(batch.column(2).to_pylist()):
            d = xxhash.xxh3_128_digest(data)
            row = held.setdefault((batch.column(0)[k].as_py(), d), [k, 0])
            row[1] += 1
        at = pa.array([k for k, _ in held.values()], pa.int64())
        texts = batch.column(2).take(at).to_pylist()
        columns = [
            batch.column(0).take(at), batch.column(1).take(at), pa.array([d for _, d in held], pa.binary()), pa.array([n for _, n in held.values()], pa.int64()),
            pa.array([pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "chunk", "d", "n", "z", "size"])


def _indexed(table: pa.Table) -> pa.Table:
    """Repeated spans of a bucket's segments that have no equal one."""
    rows = table.sort_by([("chunk", "ascending"), ("d", "ascending"), ("start", "ascending")])
    segs = rows["seg"].to_pylist()
    found = Collection(segs, LENGTH).repeated()
    single = np.asarray(rows["n"]) == 1
    chunk, d, start, stop = [], [], [], []
    for k, (c, key, at) in enumerate(zip(rows["chunk"].to_pylist(), rows["d"].to_pylist(), rows["start"].to_pylist())):
        if single[k] and found[k].any():
            turn = np.flatnonzero(np.diff(np.concatenate(([0], found[k].view(np.int8), [0]))))
            for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
                chunk.append(c), d.append(key), start.append(at + a), stop.append(at + b - 1 + LENGTH)
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "d": pa.array(d, pa.binary()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})


def _repeated(segs: DataFrame, level: int) -> DataFrame:
    """SPANS of a written table of SEGMENTS."""
    here = F.struct("chunk", "d", "base", "start", "starts")
    each = segs.groupBy("anchor", "h").agg(F.sum("weight").alias("n"), F.max("many").alias("many"), F.min(here).alias("at"))
    whole = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("others"), F.min("n").alias("least"), F.max("many").alias("any_many"))
    state = each.join(whole, "anchor").withColumn("open", F.expr("least = 1 AND (others > 1 OR any_many)")).filter("open OR n > 1")
    state = materialise(state.select("anchor", "h", "n", "others", "open", "at.*"))
    equal = segs.select("anchor", "h", "chunk", "d", "start", "starts").join(state.filter("n > 1").select("anchor", "h"), ["anchor", "h"], "left_semi")
    spans = equal.select("chunk", "d", "start", (F.col("start") + F.col("starts") + (LENGTH - 1)).alias("stop"))
    few = F.lit(level + 1 == len(LEVELS)) | (F.col("others") <= HOT)
    n_few, n_hot = state.filter("open").agg(F.count_if(few), F.count_if(~few)).first()
    texts = segs.filter("z IS NOT NULL").select("chunk", "d", "base", "z", "size").groupBy("chunk")
    fetched = lambda rows: texts.cogroup(rows.drop("h", "open").groupBy("chunk")).applyInArrow(_fetched, OPEN)
    if n_few:
        buckets = -(-n_few // BUCKET)
        dealt = fetched(state.filter("open").filter(few)).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        spans = spans.unionByName(dealt.drop("anchor", "others").groupBy("bucket").applyInArrow(_indexed, SPANS))
    if n_hot:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, chunk, d, at, texts = (batch.column(c).to_pylist() for c in range(5))
                for k, *found in segments(texts, LEVELS[level + 1]):
                    yield _rows(texts[k], chunk[k], d[k], n[k], *found, at[k])

        hot = fetched(state.filter("open").filter(~few)).select("n", "chunk", "d", "start", "seg").mapInArrow(tidy(cut), SEGMENTS)
        spans = spans.unionByName(_repeated(_written(hot), level + 1))
    return spans


def _written(frame: DataFrame) -> DataFrame:
    """A frame as a table in the shared folder."""
    path = stage_folder(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n long"


def _results(table: pa.Table, spans: pa.Table) -> pa.Table:
    held: dict[bytes, list] = {}
    for d, a, b in zip(*(spans[c].to_pylist() for c in ("d", "start", "stop"))):
        held.setdefault(d, []).append((a, b))
    keys, texts, _ = _distinct(table) if table.num_rows else ([], [], None)
    found = {}
    for d, text in zip(keys, texts):
        runs, kept, at = [], hashlib.sha256(), 0
        for a, b in sorted(held.get(d, ())):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        for a, b in runs:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        found[d] = len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()
    columns = list(zip(*(found[d] for d in table["d"].to_pylist()))) or [()] * 4
    arrays = [table["id"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))), table["n"]]
    return pa.table(dict(zip(("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n"), arrays)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = plain.schema[0].dataType.simpleString()
    chunks = shards(plain, "text")
    rows = plain.select("id", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.col("text").cast("binary").alias("text"))
    dealt = rows.mapInArrow(tidy(_packed), f"id {kind}, chunk int, d binary, n long, z binary, size long")
    texts = dealt.select("chunk", "d", "n", "z", "size")
    asked = texts.groupBy("chunk").applyInArrow(lambda table: _asked(table, chunks), exchange.REQUEST)
    segs = _written(exchange.with_answers(texts, exchange.totals(asked), lambda a, b: _kept(a, b, chunks), SEGMENTS))
    spans = _repeated(segs, 0)
    out = dealt.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_results, RESULT.replace("id long", f"id {kind}", 1))
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
