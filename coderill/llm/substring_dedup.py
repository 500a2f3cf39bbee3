"""Passages that repeat across documents, found by collinear chaining of shared k-mer seeds.

1. Seeds are hashes of ``K`` words at the minimizers of windows of ``W``: any ``K + W - 1`` equal words
   share one. The occurrences of a seed, in order of document, are a list, dealt by ranges of (seed, document), so that
   a seed that a third of all documents have is spread over tasks. Each occurrence is joined with the one in the
   document before and with the first of its range: copies link to one source or to their neighbour, and rows stay
   linear in the seeds, however common a passage is. Neighbouring seeds whose first occurrences are not neighbours
   alike are a joint; joints are joined in the same way, so that a passage made of stretches which earlier
   documents have apart gets a source of its own.
2. The matches of a document with a source are chained: in order of their place in the document, a
   Fenwick tree over the places in the source finds the best chain to extend, its score falling with the
   words skipped on either side.
3. A chain is aligned: equal words along the diagonals before, between and after its seeds, and longest
   common subsequences where the sides skip different numbers of words. Stretches of at least
   ``min_words`` equal words, of which a share of ``identity`` is equal, are passages. A chain that is none
   as a whole is cut at its gaps: the longest stretches of it that are passages count, each for itself.

Texts are compared with A-Z lower-cased. The source is a document of a smaller id. Of passages of a document that lie in
one another, the longest is returned, once. Repeats inside a document are not passages. Null and empty texts and null ids
have no seeds. Repeated rows of an id count as one document and are cut alike; of different texts under one id, the least
stands for the id, and the others are neither compared nor cut. Extra columns are dropped, or kept by ``cut``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coderill.llm import words, worker
from coderill.llm.tables import materialise

K = 6
W = 12
GAP_COST = 0.1
MIN_WORDS = 50
IDENTITY = 0.75
#: Fall of the score that ends an extension, at 3 for each word that differs.
DROP = 30
_REACH = 64
#: Ids, or spans, that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _slide(x: np.ndarray, w: int, best: np.ufunc, rest: int) -> np.ndarray:
    """Best of ``x[i : i + w]`` for each i; beyond the end stands ``rest``."""
    out, size = x.copy(), 1
    while 2 * size <= w:
        out[:-size] = best(out[:-size], out[size:])
        size *= 2
    left = w - size
    if left:
        shifted = np.full_like(out, rest)
        shifted[: len(out) - left] = out[left:]
        out = best(out, shifted)
    return out


def minimizers(w: words.Words, k: int = K, window: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (place in the slice), word place and hash of each seed, in this order."""
    n = len(w.hashes)
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return none, none, np.zeros(0, dtype=np.uint64)
    hashes, whole = words.grams(w.hashes, w.counts, k)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    hashes = np.where(whole, np.minimum(hashes, top - np.uint64(1)), top)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    place = np.arange(n) - np.repeat(np.cumsum(w.counts) - w.counts, w.counts)
    grams_here = np.maximum(w.counts - k + 1, 0)
    full = place + window <= grams_here[doc]  # windows that lie in the document
    least = np.where(full, _slide(hashes, window, np.minimum, top), np.uint64(0))
    most = _slide(least[::-1], window, np.maximum, np.uint64(0))[::-1]
    chosen = whole & (hashes == most)
    for i in np.flatnonzero((grams_here > 0) & (grams_here < window)):  # a document of less than a window
        lo = int(np.searchsorted(doc, i))
        chosen[lo + int(np.argmin(hashes[lo : lo + grams_here[i]]))] = True
    at = np.flatnonzero(chosen)
    run = np.zeros(len(at), dtype=bool)  # a word said over and over gives one seed
    run[1:] = (hashes[at[1:]] == hashes[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]]) & (at[1:] == at[:-1] + 1)
    at = at[~run]
    return doc[at], place[at], hashes[at]


def seeds(docs: DataFrame, k: int = K, window: int = W) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            ids = batch.column(0).to_numpy()
            for w in words.split_words(batch.column(1)):
                doc, place, hashes = minimizers(w, k, window)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[w.lo + doc]), pa.array(place.astype(np.int64))], names=["key", "doc_id", "place"])

    return docs.mapInArrow(worker.tidy(run), "key long, doc_id long, place long")


LINKED = "kind int, part int, key long, doc_id long, place long, first_doc long, first_place long, prev_doc long, prev_place long"
_INNER, _HEAD, _TAIL = 0, 1, 2


def _linked(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, done: int, end: bool) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Rows of LINKED (from ``key`` on) for sorted occurrences, but for the ``done`` first ones, which were rows before.

    Unless it is the ``end``, the last document's occurrences of its key may go on: also returned are the rows that are needed
    for them (of the first document of the key, of the one before, and its own), and how many of these are done.
    """
    n = len(keys)
    new_key = np.ones(n, dtype=bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new = new_key.copy()
    new[1:] |= docs[1:] != docs[:-1]
    at = np.flatnonzero(new)  # where a document's occurrences of a key begin
    size, of_row = np.diff(at, append=n), np.cumsum(new) - 1
    key_start = new_key[at]
    first = np.maximum.accumulate(np.where(key_start, np.arange(len(at)), 0))
    prev = np.where(key_start, -1, np.arange(len(at)) - 1)
    follows = np.zeros(len(at), dtype=bool)
    follows[:-1] = first[1:] == first[:-1]
    last = len(at) - 1
    to = n if end else int(at[last])
    k = np.arange(done, max(to, done))
    g = of_row[k]
    rank = k - at[g]  # the i-th occurrence in a document meets the i-th in another, going round where that has fewer
    known = prev[g] >= 0
    k_prev, k_first = np.where(known, at[prev[g]] + rank % size[prev[g]], k), np.where(known, at[first[g]] + rank % size[first[g]], k)
    kept = known | follows[g]
    out = [x[kept] for x in (keys[k], docs[k], places[k], docs[k_first], places[k_first], docs[k_prev], places[k_prev], known)]
    if end:
        return out, np.zeros(0, dtype=np.int64), 0
    groups = sorted({int(first[last]), int(max(prev[last], first[last])), last})
    rest = np.concatenate([np.arange(at[x], at[x] + size[x]) for x in groups])
    return out, rest, len(rest) - int(size[last])


def linked(found: DataFrame) -> DataFrame:
    """(key, doc_id, place, first_doc, first_place, prev_doc, prev_place) for keys that two documents have.

    ``found`` is (key, doc_id, place). Of each occurrence in a document that is not the first of its range: the occurrence of the
    same rank in the first document of the range and in the document before; of the first one, itself and none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [f.split()[0] for f in LINKED.split(", ")]

        def rows(columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
            known = columns[7]
            n = len(columns[0])
            head = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32))]
            return pa.RecordBatch.from_arrays([*head, *(pa.array(c.astype(np.int64)) for c in columns[:5]), pa.array(columns[5].astype(np.int64), mask=~known), pa.array(columns[6].astype(np.int64), mask=~known)], names=names)

        def one(columns: list[np.ndarray], i: int, first: int, kind: int) -> pa.RecordBatch:
            """A row of the range's first or last document, for the ranges beside."""
            key, doc, place = (c[i : i + 1] for c in columns)
            return rows([key, doc, place, columns[1][first : first + 1], columns[2][first : first + 1], doc, place, np.zeros(1, dtype=bool)], kind)

        held, done, begun = None, 0, False
        for batch in _with_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(3)] if batch is not None else []
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)] if columns else held
            if not columns:
                continue
            if not begun:  # the first document of the range may have ones before it
                begun = True
                yield one(columns, 0, 0, _HEAD)
            out, rest, n_done = _linked(*columns, done, batch is None)
            if len(out[0]):
                yield rows(out, _INNER)
            if batch is None:
                last = int(np.flatnonzero((columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]))[0])
                yield one(columns, last, int(np.flatnonzero(columns[0] == columns[0][-1])[0]), _TAIL)
            held, done = [c[rest] for c in columns], n_done

    dealt = found.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "place")
    out = materialise(dealt.mapInArrow(worker.tidy(run), LINKED))
    # a range that begins within a key: the end of the range before has the document before; a row for each range
    heads, tails = out.filter(F.col("kind") == _HEAD), out.filter(F.col("kind") == _TAIL)
    before = F.lag(F.struct("key", "doc_id", "place", "first_doc", "first_place")).over(Window.orderBy("part"))
    joined = heads.join(tails.select("part", before.alias("t")), "part").filter("key = t.key")
    own = ("key", "doc_id", "place")
    ended = joined.select(*own, "t.first_doc", "t.first_place", F.col("t.doc_id").alias("prev_doc"), F.col("t.place").alias("prev_place"))
    return out.filter(F.col("kind") == _INNER).select(*own, "first_doc", "first_place", "prev_doc", "prev_place").unionByName(ended)


class Fenwick:
    """Greatest value, and who has it, over a prefix of ranks."""

    def __init__(self, n: int):
        self.best = [(0.0, -1)] * (n + 1)

    def update(self, rank: int, value: float, who: int) -> None:
        rank += 1
        best, n, item = self.best, len(self.best), (value, who)
        while rank < n:
            if best[rank] < item:
                best[rank] = item
            rank += rank & -rank

    def greatest(self, rank: int) -> tuple[float, int]:
        """Over ranks below ``rank``."""
        best, out = self.best, (0.0, -1)
        while rank:
            if best[rank] > out:
                out = best[rank]
            rank -= rank & -rank
        return out


def chains(place: list[int], source: list[int], k: int = K, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Matches of the best collinear chains, each match in one at most.

    A chain's score is ``k`` for each match less ``gap_cost`` for each word skipped on either side.
    """
    order = sorted(range(len(place)), key=lambda i: (place[i], -source[i]))
    ranks = {s: r for r, s in enumerate(sorted(set(source)))}
    tree = Fenwick(len(ranks))
    score, parent = [0.0] * len(place), [-1] * len(place)
    for i in order:
        here = gap_cost * (place[i] + source[i])
        value, before = tree.greatest(ranks[source[i]])
        score[i] = float(k)
        if before >= 0 and (gain := value - here + 2 * gap_cost * k) > 0:
            score[i] += min(gain, score[before])
            parent[i] = before
        tree.update(ranks[source[i]], score[i] + here, i)
    used, out = [False] * len(place), []
    for i in sorted(range(len(place)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = parent[i]
        if chain:
            out.append(chain[::-1])
    return out


def levels(spans: list[tuple[int, int, int]], most: int) -> list[int]:
    """Of each chain (first place, last place, seeds) of a document, in which round it is aligned, from 1 to ``most``.

    In the first are those that lie in no greater one of the round, in the next those of the others that do, and so on.
    """
    out, left = [most] * len(spans), sorted(range(len(spans)), key=lambda i: (-spans[i][2], spans[i][0], i))
    for level in range(1, most):
        taken: list[tuple[int, int]] = []  # neither lies in another, so both ends rise
        rest = []
        for i in left:
            first, last, _ = spans[i]
            at = bisect_right(taken, (first, 1 << 60)) - 1
            if at >= 0 and taken[at][1] >= last:
                rest.append(i)
                continue
            out[i] = level
            lo = bisect_left(taken, (first, -1))
            hi = lo
            while hi < len(taken) and taken[hi][1] <= last:
                hi += 1
            taken[lo:hi] = [(first, last)]
        left = rest
    return out


CHAINS = "doc_id long, source long, places binary, sources binary"


def seeded(places: np.ndarray, sources: np.ndarray, k: int) -> int:
    """Words that the seeds of a chain cover, on the side where that is less."""
    return min(int(np.minimum(np.diff(x), k).sum()) + k for x in (places, sources))


def joints(place: np.ndarray, source: np.ndarray, source_place: np.ndarray, held: list[tuple[int, int]] | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Key and places of neighbouring seeds of a document that lie otherwise in their sources, outside of ``held``."""
    rows = np.unique(np.stack([place.astype(np.int64), source, source_place.astype(np.int64)], axis=1), axis=0)
    a, b = rows[:-1], rows[1:]
    joint = (a[:, 1] != b[:, 1]) | (b[:, 2] - a[:, 2] != b[:, 0] - a[:, 0])
    for first, last in held:
        joint &= (a[:, 0] < first) | (b[:, 0] > last)
    a, b = a[joint], b[joint]
    key = np.zeros(len(a), dtype=np.uint64)
    for part in (a[:, 1], a[:, 2], b[:, 1], b[:, 2], b[:, 0] - a[:, 0]):
        key = words.mix(key * np.uint64(0xD6E8FEB86659FD93) + part.astype(np.uint64))
    return key.view(np.int64), np.stack([a[:, 0], b[:, 0]], axis=1).astype(np.int32)


def second_chains(found: DataFrame) -> DataFrame:
    """CHAINS of two matches each: joints with their first occurrence and the one before."""
    rows = found.filter("length(sources) = 0")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both[:, 0] << 32 | both[:, 1])], names=["key", "doc_id", "place"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.stack([c >> 32, c & 0xFFFFFFFF], axis=1).astype(np.int32) for c in (batch.column(k).to_numpy() for k in (2, 3))]
            blobs = [pa.array([x.tobytes() for x in both], pa.binary()) for both in places]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *blobs], names=["doc_id", "source", "places", "sources"])

    tied = linked(rows.select(F.col("source").alias("key"), "doc_id", "places").mapInArrow(packed, "key long, doc_id long, place long"))
    first, before = (tied.select("doc_id", F.col(f"{who}_doc").alias("source"), "place", F.col(f"{who}_place").alias("source_place"), "prev_doc") for who in ("first", "prev"))
    both = first.filter("source <> prev_doc").union(before.filter("source IS NOT NULL"))
    return both.drop("prev_doc").mapInArrow(opened, CHAINS)


def rechained(spans: list[tuple[int, np.ndarray, np.ndarray, bool]], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Chains (source, places, source places) of a document; where joints are among those of a source, all its matches are chained again."""
    again = {source for source, _, _, joint in spans if joint}
    out = [(source, p, s) for source, p, s, _ in spans if source not in again]
    for source in sorted(again):
        held = np.unique(np.concatenate([np.stack([p, s], axis=1) for x, p, s, _ in spans if x == source]), axis=0)
        out += [(source, held[c, 0], held[c, 1]) for c in chains(held[:, 0].tolist(), held[:, 1].tolist(), k)]
    return out


def chained(matched: DataFrame, k: int = K, gap_cost: float = GAP_COST, min_words: int = MIN_WORDS) -> DataFrame:
    """CHAINS of each document with its sources, and its joints: the key as source, and no source places.

    Joints inside of a chain that holds ``min_words`` words of seeds, half of its words or more, are left out: it has a source for both sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            columns = [*(c.fill_null(0).to_numpy() for c in batch.columns), batch.column(4).is_valid().to_numpy(zero_copy_only=False)] if batch is not None else None
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)] if columns else rest
            if columns is None or not len(columns[0]):
                continue
            doc = columns[0]
            edges = np.flatnonzero(doc[1:] != doc[:-1]) + 1
            cuts = [0, *edges.tolist(), len(doc)]
            if batch is not None:  # the last document may go on in the next batch
                rest = [c[cuts[-2] :] for c in columns]
                cuts.pop()
            rows: tuple[list, ...] = ([], [], [], [])
            for lo, hi in zip(cuts, cuts[1:]):
                place, first, first_place, before, before_place, known = (c[lo:hi] for c in columns[1:])
                other = (first != doc[lo]) & ~(known & (first == before))
                pairs = np.concatenate([np.stack([first, place, first_place], axis=1)[other], np.stack([before, place, before_place], axis=1)[known]])
                pairs = np.unique(pairs, axis=0)
                held: list[tuple[int, int]] = []
                for part in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else ():
                    p, s = part[:, 1], part[:, 2]
                    for chain in chains(p.tolist(), s.tolist(), k, gap_cost):
                        if seeded(p[chain], s[chain], k) >= max(min_words, 0.5 * (p[chain[-1]] - p[chain[0]] + k)):
                            held.append((int(p[chain[0]]), int(p[chain[-1]])))
                        for column, value in zip(rows, (doc[lo], part[0, 0], p[chain].astype(np.int32).tobytes(), s[chain].astype(np.int32).tobytes())):
                            column.append(value)
                for key, both in zip(*joints(place, first, first_place, held)):
                    for column, value in zip(rows, (doc[lo], key, both.tobytes(), b"")):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["doc_id", "source", "places", "sources"])

    rows = matched.select("doc_id", "place", "first_doc", "first_place", "prev_doc", "prev_place")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(worker.tidy(run), CHAINS)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of whole numbers."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b.tolist():
        both = row & where.get(y, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words to go on from two starts, and the equal ones of them: the best of +1 and -3, ended by a drop of ``DROP``.

    So three in four of the words gone on by are equal at least, and no passage falls below that by going on.
    """
    whole = min(len(a), len(b))
    n = min(whole, 256)
    while n:
        same = a[:n] == b[:n]
        score = np.cumsum(np.where(same, 1, -3))
        fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
        if len(fallen) or n == whole:
            end = int(fallen[0]) if len(fallen) else n
            if not end or score[:end].max() <= 0:
                return 0, 0
            best = int(np.argmax(score[:end])) + 1
            return best, int(same[:best].sum())
        n = min(whole, 4 * n)  # few go on far
    return 0, 0


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return int((a[:n] == b[:n]).sum())


def _blocks(doc: np.ndarray, source: np.ndarray, places: np.ndarray, sources: np.ndarray, k: int) -> list[list[int]]:
    """Runs of a chain's seeds without a word skipped: start and end in both, equal words, and those of the gap before."""
    out = [[int(places[0]), int(places[0]), int(sources[0]), int(sources[0]), 0, 0]]
    for p, s in zip(places.tolist(), sources.tolist()):
        _, at, _, source_at, _, _ = last = out[-1]
        end, source_end = max(at, p + k), max(source_at, s + k)
        if p - at == s - source_at:
            if p <= at:
                last[4] += _equal(doc[at:end], source[source_at:source_end])
                last[1], last[3] = end, source_end
            else:
                out.append([p, end, s, source_end, _equal(doc[p:end], source[s:source_end]), _equal(doc[at:p], source[source_at:s])])
        else:
            gap, source_gap = doc[at : max(at, p)], source[source_at : max(source_at, s)]
            common = common_subsequence(gap, source_gap) if len(gap) and len(source_gap) else 0
            over = max(0, at - p, source_at - s)  # a match that overlaps what is aligned counts from there on
            out.append([max(at, p), end, max(source_at, s), source_end, max(0, k - over), common])
    return out


def align(doc: np.ndarray, source: np.ndarray, places: np.ndarray, sources: np.ndarray, k: int = K, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """Start and end in both, and equal words, of the passages around a chain of matches.

    That is the whole chain where it is one, else the fewest of its longest stretches, from block to block,
    that hold all words of stretches which are; and what lies on one diagonal with a seed and is a passage, if it is in none of these.
    """
    blocks = np.array(_blocks(doc, source, places, sources, k), dtype=np.int64)
    start, end, source_start, source_end, equal, gap = blocks.T
    n, sums = len(blocks), np.cumsum(equal + gap)
    backs, ons = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)

    def reach(i: int, j: int) -> None:
        backs[i] = _extend(doc[: start[i]][::-1], source[: source_start[i]][::-1])
        ons[j] = _extend(doc[end[j] :], source[source_end[j] :])

    def judged(i: int, j: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from block ``i`` to ``j`` with what they extend to, and whether that is a passage."""
        same = sums[j] - sums[i] + equal[i] + backs[i, 1] + ons[j, 1]
        span = np.maximum(end[j] - start[i], source_end[j] - source_start[i]) + backs[i, 0] + ons[j, 0]
        return same, (same >= min_words) & (same / span >= identity)

    def stretch(i: int, j: int) -> tuple[int, int, int, int, int]:
        back, on = int(backs[i, 0]), int(ons[j, 0])
        return int(start[i]) - back, int(end[j]) + on, int(source_start[i]) - back, int(source_end[j]) + on, int(judged(i, j)[0])

    def found() -> list[tuple[int, int, int, int, int]]:
        reach(0, n - 1)
        if judged(0, n - 1)[1]:
            return [stretch(0, n - 1)]
        longest: list[tuple[int, int]] = []
        if n > 1:
            for i in range(n):
                reach(i, i)
            for i in range(n):
                good = np.flatnonzero(judged(i, np.arange(i, n))[1])
                if len(good) and (not longest or i + good[-1] > longest[-1][1]):
                    while len(longest) > 1 and longest[-2][1] >= i - 1:
                        longest.pop()  # the one before and this one hold it
                    longest.append((i, i + int(good[-1])))
        return [stretch(i, j) for i, j in longest]

    out = found()
    # a chain of seeds that stand elsewhere too can leave the diagonal of a passage and end before it does
    for one in _diagonals(doc, source, places, sources):
        first, last, *_, same = one
        if same >= min_words and same >= identity * (last - first) and not any(a <= first and last <= b for a, b, *_ in out):
            out.append(one)
    return out


def _diagonals(doc: np.ndarray, source: np.ndarray, places: np.ndarray, sources: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Start and end in both, and equal words, of what each diagonal of a chain's seeds extends to; none if there is only one."""
    shift = places.astype(np.int64) - sources
    if (shift == shift[0]).all():
        return []
    out: list[tuple[int, int, int, int, int]] = []
    diagonal, to = None, 0
    for i in np.lexsort((places, shift)).tolist():
        p, s = int(places[i]), int(sources[i])
        if p - s == diagonal and p < to:
            continue  # it is in what the one before extends to
        back, same_back = _extend(doc[:p][::-1], source[:s][::-1])
        on, same_on = _extend(doc[p:], source[s:])
        diagonal, to = p - s, p + on
        out.append((p - back, to, s - back, s + on, same_back + same_on))
    return out


PASSAGES = "doc_id long, start int, end int, source_id long, source_start int, source_end int, n_equal int, identity double"


class _Segments:
    """Word hashes of the text asked for last, as rows come in order of their document."""

    def __init__(self) -> None:
        self.key, self.hashes = None, np.zeros(0, dtype=np.uint64)

    def of(self, key: int, text: pa.Array) -> np.ndarray:
        if key != self.key:
            parts = [w.hashes for w in words.split_words(text)]
            self.key, self.hashes = key, parts[0] if parts else self.hashes[:0]
        return self.hashes


def one_text(plain: DataFrame) -> DataFrame:
    """(doc_id, text) with the least text of each id that has several rows."""
    several = materialise(plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    n = several.count()
    if not n:
        return plain
    several = F.broadcast(several) if n <= BROADCAST_ROWS else several
    return plain.join(several, "doc_id", "left_anti").unionByName(plain.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


_CHAIN = "array<struct<source:bigint,level:int,first:int,last:int,places:binary,sources:binary>>"
_ROUNDS = 3
#: Bytes of chains, or of words cut out around them, that are broadcast at most, so that texts need no shuffle.
BROADCAST_BYTES = 32 << 20


def _picked(chains_of: DataFrame, k: int) -> DataFrame:
    """(doc_id, chains): a row for each document, with joints among its chains chained again, and the round of each."""
    chain = F.struct("source", "places", "sources", "joint")
    by_doc = chains_of.groupBy("doc_id").agg(F.collect_list(chain).alias("chains"))  # no more than the document has seeds
    kind = pa.list_(pa.struct([("source", pa.int64()), ("level", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("places", pa.binary()), ("sources", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, out = batch.slice(lo, 200), []
                for chains_here in part.column(1).to_pylist():
                    some = rechained([(c["source"], np.frombuffer(c["places"], np.int32), np.frombuffer(c["sources"], np.int32), c["joint"]) for c in chains_here], k)
                    some.sort(key=lambda c: (c[0], int(c[1][0]), int(c[2][0])))
                    spans = [(int(p[0]), int(p[-1]), len(p)) for _, p, _ in some]
                    out.append([
                        {"source": source, "level": level, "first": first, "last": last, "places": p.astype(np.int32).tobytes(), "sources": s.astype(np.int32).tobytes()}
                        for (source, p, s), (first, last, _), level in zip(some, spans, levels(spans, _ROUNDS))
                    ])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["doc_id", "chains"])

    return by_doc.mapInArrow(worker.tidy(run), f"doc_id long, chains {_CHAIN}")


_CUT_OUT = "source long, doc_id long, lo int, more boolean, places binary, sources binary, segment binary"
_ALIGNED = f"{PASSAGES}, places binary, sources binary"


def _aligned(chains_of: DataFrame, plain: DataFrame, reach: int, min_words: int, identity: float, k: int) -> DataFrame:
    """_ALIGNED rows of chains (doc_id, chains): passages, and the chains of those that end where ``reach`` words beyond them do."""
    pairs = chains_of.select("doc_id", F.explode("chains").alias("c"))
    asked = pairs.select("doc_id").union(pairs.select("c.source")).distinct()
    few = asked.count() <= BROADCAST_ROWS
    # both joins take the texts by one name, so that their shuffle is written once
    texts = plain.join(F.broadcast(asked) if few else asked, "doc_id", "left_semi").withColumnRenamed("doc_id", "__id")
    size = F.aggregate("chains", F.lit(0).cast("long"), lambda n, c: n + F.octet_length(c["places"]) * 2 + 32)
    cut = F.aggregate("chains", F.lit(0).cast("long"), lambda n, c: n + 8 * (c["last"] - c["first"] + k + 2 * reach) + 64)
    chain_bytes, cut_bytes = (x or 0 for x in chains_of.agg(F.sum(size), F.sum(size + cut)).first())
    by_doc = F.broadcast(chains_of) if chain_bytes <= BROADCAST_BYTES else chains_of

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _Segments()
        for batch in words.slices(batches, "text", 1 << 22):
            for i, (doc, chains_here) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                hashes = segments.of(doc, batch.column(1).slice(i, 1))
                rows: list[tuple] = []
                for c in chains_here:
                    places = np.frombuffer(c["places"], np.int32)
                    lo, hi = max(0, int(places[0]) - reach), int(places[-1]) + k + reach
                    rows.append((c["source"], doc, lo, hi < len(hashes), c["places"], c["sources"], hashes[lo:hi].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _CUT_OUT.split(", ")])

    cut_out = by_doc.join(texts, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "chains").mapInArrow(worker.tidy(segment), _CUT_OUT)
    sourced = (F.broadcast(cut_out) if cut_bytes <= BROADCAST_BYTES else cut_out).join(texts, F.col("source") == F.col("__id")).select("source", "text", "doc_id", "lo", "more", "places", "sources", "segment")

    def align_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _Segments()
        for batch in words.slices(batches, "text", 1 << 22):
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6, 7)]
            for i, (source, doc, lo, more, places, sources, segment) in enumerate(zip(*columns)):
                hashes = segments.of(source, batch.column(1).slice(i, 1))
                p, s = np.frombuffer(places, np.int32), np.frombuffer(sources, np.int32)
                source_lo = max(0, int(s[0]) - reach)
                part, own = hashes[source_lo : int(s[-1]) + k + reach], np.frombuffer(segment, np.uint64)
                source_more = source_lo + len(part) < len(hashes)
                for start, end, source_start, source_end, equal in align(own, part, p - lo, s - source_lo, k, min_words, identity):
                    # words that both texts have beyond what lies here may go on
                    ahead = (start == 0 and lo > 0 or source_start == 0 and source_lo > 0) and (start > 0 or lo > 0) and (source_start > 0 or source_lo > 0)
                    behind = (end == len(own) and more or source_end == len(part) and source_more) and (end < len(own) or more) and (source_end < len(part) or source_more)
                    share = equal / max(end - start, source_end - source_start)
                    chain = (places, sources) if ahead or behind else (None, None)
                    rows.append((doc, start + lo, end + lo, source, source_start + source_lo, source_end + source_lo, equal, share, *chain))
            columns = list(zip(*rows)) or [()] * 10
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _ALIGNED.split(", ")])

    return sourced.mapInArrow(worker.tidy(align_all), _ALIGNED)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY, k: int = K, window: int = W) -> DataFrame:
    """Rows of PASSAGES: words ``start`` to ``end`` of a document repeat those of its source.

    Chains are aligned in rounds, the greater ones of a document first; one whose seeds lie in a passage that is found is
    left out, as it finds the same words again, and beyond them less than what holds another seed. In a group of near copies,
    whose seeds each have another document before, that leaves each document few chains.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plain = one_text(plain.filter("doc_id IS NOT NULL AND text IS NOT NULL"))
    first_round = materialise(chained(linked(seeds(plain, k, window)), k, min_words=min_words))
    second_round = materialise(second_chains(first_round))
    both = first_round.filter("length(sources) > 0").withColumn("joint", F.lit(False)).union(second_round.withColumn("joint", F.lit(True)))
    picked = materialise(_picked(both, k))
    found = None
    for level in range(1, _ROUNDS + 1):
        here = F.filter("chains", lambda c: c["level"] == level)
        if found is None:
            open_chains = picked.select("doc_id", here.alias("chains"))
        else:
            spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
            outside = lambda c: ~F.exists("spans", lambda x: (x["start"] <= c["first"]) & (x["end"] >= c["last"] + k))
            mine = picked.filter(F.exists("chains", lambda c: c["level"] == level))
            open_chains = mine.join(spans, "doc_id", "left").select("doc_id", F.when(F.col("spans").isNull(), here).otherwise(F.filter(here, outside)).alias("chains"))
        open_chains = materialise(open_chains.filter(F.size("chains") > 0))
        reach = _REACH
        while not open_chains.isEmpty():
            part = materialise(_aligned(open_chains, plain, reach, min_words, identity, k))
            rows = part.drop("places", "sources")
            found = rows if found is None else found.unionByName(rows)
            again = F.struct(F.col("source_id").alias("source"), F.lit(level).alias("level"), F.col("start").alias("first"), F.col("end").alias("last"), "places", "sources")
            open_chains = materialise(part.filter("places IS NOT NULL").groupBy("doc_id").agg(F.collect_set(again).alias("chains")))
            reach *= 16  # few go on beyond what lay there
    if found is None:
        return plain.sparkSession.createDataFrame([], PASSAGES)
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "source_id", "source_start").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("__to", F.max("end").over(before)).filter("__to IS NULL OR end > __to").drop("__to")


def cut(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of their passages; documents of which no word stays are gone.

    All columns are kept; ``n_chars``, where there is one, is counted anew in the texts that change. Of several texts
    under one id only the least, which the passages are of, is cut.
    """
    own, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    hashed = docs.select(own.alias("__doc"), F.xxhash64(text).alias("h")).filter(own.isNotNull() & text.isNotNull())
    several = materialise(hashed.groupBy("__doc").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("__doc"))
    spans = materialise(found.select(F.col("doc_id").alias("__doc"), F.struct("start", "end").alias("span")))
    few = spans.count() <= BROADCAST_ROWS
    grouped = spans.groupBy("__doc").agg(F.sort_array(F.collect_set("span")).alias("__spans"))
    if not several.isEmpty():
        least = docs.select(own.alias("__doc"), text.alias("__text")).join(several, "__doc", "left_semi").groupBy("__doc").agg(F.xxhash64(F.min("__text")).alias("__least"))
        grouped = grouped.join(least, "__doc", "left")
        same = (own == F.col("__doc")) & (F.col("__least").isNull() | (F.col("__least") == F.xxhash64(text)))
        joined = docs.join(grouped, same, "left").drop("__doc", "__least")
    else:
        joined = docs.join(F.broadcast(grouped) if few else grouped, own == F.col("__doc"), "left").drop("__doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, spans = words.as_strings(batch.column(at)), batch.column(batch.num_columns - 1)
            new, keep, changed = batch.column(at).cast(pa.string()).to_pylist(), np.ones(batch.num_rows, dtype=bool), np.zeros(batch.num_rows, dtype=bool)
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                (w,) = words.split_words(texts.slice(i, 1))
                gone = np.zeros(len(w.hashes), dtype=bool)
                for s in spans[i].as_py():
                    gone[s["start"] : s["end"]] = True
                data, kept, last = (new[i] or "").encode(), [], 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    kept.append(data[last : w.starts[a]])
                    last = int(w.starts[b]) if b < len(gone) else len(data)
                new[i] = b"".join([*kept, data[last:]]).decode()
                keep[i], changed[i] = not gone.all(), True
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed)], names=[*batch.schema.names[:-1], "__changed"]).filter(pa.array(keep))

    kept = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema)
    out = joined.mapInArrow(worker.tidy(run), f"{kept}, __changed boolean")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.char_length(text_col).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
