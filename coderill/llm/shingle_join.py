"""Exact Jaccard self-join of word n-gram sets on a prefix tree, and its components.

1. Every document's set gets the document frequency of each n-gram (``exchange``). In the global order
   by rising frequency a set of ``n`` can only link if one of its first ``n - ceil(t n) + 1`` n-grams is
   shared; n-grams that no other document has come first there and match nothing, so most documents end
   here, and the others carry on with their shared n-grams alone.
2. Documents with equal sets are one class with its smallest id.
3. Classes that share a prefix n-gram are tied to the smallest one that has it; the components of these
   ties are groups, outside of which nothing can link. A group of more than ``BLOCK`` classes is cut into
   blocks by a hash.
4. A block is joined on a prefix tree of its sets, in falling order of frequency. A probe walks down the
   tree with the overlap so far, which all sets below a node share, and leaves a subtree when what
   remains of the probe and of the longest set below can no longer reach the overlap that their sizes
   need, or when all sets below are already in the probe's component: links are exact, and components
   lose none, though pairs inside a component are not listed.
5. Blocks of a larger group are joined with one another in the same way, members of different components
   only, after a first round between some members of each component of each block.

Sizes and links are exact up to collisions of 48-bit n-gram hashes within a pair of documents.

Null and empty texts have an empty set and link with nothing. Repeated rows give repeated rows. A row
with a null id gets its set size and a null component, and links with nothing. Extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coderill.llm import exchange, words, worker
from coderill.llm.graph import Forest, components
from coderill.llm.tables import join_groups, materialise, shards

N = 5
PERCENT = 75
BLOCK = 4096
_LEADERS = 4


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap with which sets of ``a`` and ``b`` members reach ``percent`` of their union."""
    return -(-percent * (a + b) // (100 + percent))


def document_sets(texts: pa.ChunkedArray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the documents' n-gram sets, and the sorted distinct hashes of one after another."""
    sizes, sets = [], []
    for w in words.split_words(texts):
        hashes, whole = words.grams(w.hashes, w.counts, n)
        bounds = w.bounds()
        for i, count in enumerate(w.counts):
            a, b = bounds[i], bounds[i + 1]
            if count >= n:
                one = np.unique(hashes[a:b][whole[a:b]])
            elif count:
                one = words.grams(w.hashes[a:b], np.array([count]), int(count))[0][:1]
            else:
                one = hashes[:0]
            sizes.append(len(one))
            sets.append(one)
    return np.array(sizes, dtype=np.int64), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _sums(values: np.ndarray, sizes: np.ndarray, add: np.ufunc) -> np.ndarray:
    out = np.zeros(len(sizes), dtype=values.dtype)
    full = sizes > 0
    if full.any():
        out[full] = add.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


SETS = "doc_id long, n long, f long, g long, own long, shared binary"


def shared_sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, f, g, own, shared): set size, fingerprint, n-grams of no other document, and the others
    as order keys (frequency, then hash) where the document can link at all, else null."""
    chunks = shards(docs, "text")
    chunked = docs.select("doc_id", "text", exchange.chunk_of(chunks).alias("chunk"))

    def ask(table: pa.Table) -> pa.Table:
        _, members = document_sets(table["text"], n)
        return exchange.requests(table["chunk"][0].as_py(), *np.unique(members, return_counts=True), chunks)

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, members = document_sets(table["text"], n)
        keys = np.unique(members)
        counts = exchange.answered(answers, keys, chunks)[np.searchsorted(keys, members)]
        own = _sums((counts == 1).astype(np.int64), sizes, np.add)
        f = _sums(members, sizes, np.add).view(np.int64)
        g = _sums(words.mix(members + np.uint64(n)), sizes, np.bitwise_xor).view(np.int64)
        order = np.minimum(counts, 65535).astype(np.uint64) << np.uint64(48) | members >> np.uint64(16)
        prefix = sizes + -percent * sizes // 100 + 1
        at, shared = 0, []
        for i, size in enumerate(sizes):
            keep = size and prefix[i] > own[i]
            shared.append(np.sort(order[at : at + size][counts[at : at + size] > 1]).tobytes() if keep else None)
            at += size
        return pa.table({"doc_id": table["doc_id"], "n": sizes, "f": f, "g": g, "own": own, "shared": pa.array(shared, pa.binary())})

    asked = chunked.groupBy("chunk").applyInArrow(ask, exchange.REQUEST)
    return exchange.with_answers(chunked, exchange.totals(asked), judge, SETS)


class PrefixTree:
    """Path-compressed tree over sets that are listed in falling order of their keys."""

    __slots__ = ("root", "forest", "percent")

    def __init__(self, forest: Forest, percent: int):
        # a node: [label, children by first key, sets that end here, (least n, greatest n, longest rest), one component or -1]
        self.root: list = [[], {}, [], [1 << 60, 0, 0], None]
        self.forest, self.percent = forest, percent

    def insert(self, doc: int, n: int, keys: list[int]) -> None:
        node, at = self.root, 0
        while True:
            self._note(node, doc, n, len(keys) - at)
            if at == len(keys):
                node[2].append((doc, n))
                return
            child = node[1].get(keys[at])
            if child is None:
                node[1][keys[at]] = leaf = [keys[at:], {}, [(doc, n)], [1 << 60, 0, 0], None]
                self._note(leaf, doc, n, 0)
                return
            label, same = child[0], 1
            most = min(len(label), len(keys) - at)
            while same < most and label[same] == keys[at + same]:
                same += 1
            if same < len(label):  # cut the edge
                low, high, rest = child[3]
                upper = [label[:same], {label[same]: child}, [], [low, high, rest + len(label) - same], child[4]]
                child[0] = label[same:]
                node[1][keys[at]] = upper
                child = upper
            node, at = child, at + same

    def _note(self, node: list, doc: int, n: int, rest: int) -> None:
        stats = node[3]
        stats[0], stats[1], stats[2] = min(stats[0], n), max(stats[1], n), max(stats[2], rest)
        if node[4] is None:
            node[4] = doc
        elif node[4] >= 0 and self.forest.find(node[4]) != self.forest.find(doc):
            node[4] = -1

    def probe(self, doc: int, n: int, keys: list[int]) -> None:
        """Join ``doc`` with the components of all sets that it links with."""
        find, percent = self.forest.find, self.percent
        members = set(keys)
        falling = [-k for k in keys]
        has = members.__contains__
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            for m, size in node[2]:
                if find(m) != find(doc) and overlap >= needed(n, size, percent):
                    self.forest.join(m, doc)
            for child in node[1].values():
                low, high, rest = child[3]
                if 100 * high < percent * n or percent * low > 100 * n:
                    continue
                if child[4] >= 0 and find(child[4]) == find(doc):
                    continue
                label = child[0]
                least = needed(n, max(low, -(-percent * n // 100)), percent)
                if overlap + min(len(keys) - at, len(label) + rest) < least:
                    continue
                now = overlap + sum(map(has, label))
                then = bisect_right(falling, -label[-1])
                if now + min(len(keys) - then, rest) >= least:
                    stack.append((child, now, then))


def join_block(rows: list[tuple[int, int, bytes]], percent: int, sides: list[int] | None = None, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges (id, id) that tie the components of the sets (id, n, shared keys) together.

    With ``labels``, sets of a label are tied already. With ``sides``, only sets of different sides meet.
    """
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][0]))
    forest = Forest(len(rows))
    if labels is not None:
        first: dict[int, int] = {}
        for i in order:
            forest.join(first.setdefault(labels[i], i), i)
    before = list(map(forest.find, range(len(rows))))
    keys = {i: np.frombuffer(rows[i][2], np.uint64)[::-1].tolist() for i in order}
    trees = {s: PrefixTree(forest, percent) for s in set(sides or [0])}
    if sides is None:
        for i in order:
            trees[0].probe(i, rows[i][1], keys[i])
            trees[0].insert(i, rows[i][1], keys[i])
    else:
        for i in order:
            if sides[i] == 0:
                trees[0].insert(i, rows[i][1], keys[i])
        for i in order:
            if sides[i] != 0 and 0 in trees:
                trees[0].probe(i, rows[i][1], keys[i])
    return [(rows[i][0], rows[forest.find(i)][0]) for i in range(len(rows)) if forest.find(i) != before[i] or (labels is None and forest.find(i) != i)]


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id) for the shared n-grams in each set's prefix."""

    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for doc, n, own, shared in zip(*(batch.column(k).to_pylist() for k in range(4))):
                some = np.frombuffer(shared, np.uint64)[: n + -percent * n // 100 + 1 - own]
                keys.append(some)
                ids.append(np.full(len(some), doc))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "doc_id"])

    return sets.select("doc_id", "n", "own", "shared").mapInArrow(worker.tidy(run), "key long, doc_id long")


EDGES = "a long, b long"


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _join_blocks(blocks: DataFrame, keys: list[str], percent: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("doc_id", "n", "shared"))))
        return _edges(join_block(rows, percent))

    return blocks.select(*keys, "doc_id", "n", "shared").groupBy(*keys).applyInArrow(run, EDGES)


def _across(blocks: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Edges between the blocks of groups that have several."""
    labelled = blocks.join(components(edges).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = materialise(labelled.withColumn("label", F.coalesce("component", "doc_id")).drop("component"))
    by = Window.partitionBy("group", "block", "label").orderBy(F.xxhash64("doc_id"), "doc_id")
    leaders = labelled.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= _LEADERS)
    per_group = leaders.groupBy("group").agg(F.count(F.lit(1)).alias("of_group"))
    leaders = leaders.join(per_group, "group").withColumn("part", F.pmod(F.xxhash64("label"), F.ceil(F.col("of_group") / BLOCK)))
    edges = materialise(edges.unionByName(_join_blocks(leaders, ["group", "part"], percent)))
    labelled = labelled.drop("label").join(components(edges).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = materialise(labelled.withColumn("label", F.coalesce("component", "doc_id")).drop("component"))
    spans = labelled.groupBy("group", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left, right = (spans.select("group", *(F.col(c).alias(f"{s}_{c}") for c in ("block", "low", "high"))) for s in "lr")
    meets = left.join(right, "group").filter("l_block < r_block AND NOT (l_low = l_high AND r_low = r_high AND l_low = r_low)")
    sides = [meets.select("group", "l_block", "r_block", F.col(f"{s}_block").alias("block"), F.lit(k).alias("side")) for k, s in enumerate("lr")]
    dealt = sides[0].unionByName(sides[1]).join(labelled, ["group", "block"])

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("doc_id", "n", "shared"))))
        return _edges(join_block(rows, percent, table["side"].to_pylist(), table["label"].to_pylist()))

    found = dealt.select("group", "l_block", "r_block", "side", "label", "doc_id", "n", "shared").groupBy("group", "l_block", "r_block").applyInArrow(run, EDGES)
    return edges.unionByName(found)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sets = materialise(shared_sets(plain, n, percent))
    can = sets.filter("shared IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(can.groupBy("n", "f", "g").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("__n")))
    firsts = can.join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    prefixes = _prefixes(firsts, percent)
    ties = prefixes.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).filter("top > b").drop("top")
    groups = components(prefixes.join(ties, "key").filter("doc_id > b").select(F.col("doc_id").alias("a"), "b"))
    groups = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    sizes = groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    blocks = firsts.select("doc_id", "n", "shared").join(groups.join(sizes, "group"), "doc_id")
    blocks = materialise(blocks.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    edges = materialise(_join_blocks(blocks, ["group", "block"], percent))
    several = blocks.filter("blocks > 1")
    if not several.isEmpty():
        edges = _across(several.drop("blocks"), edges, percent)
    linked = components(edges).withColumnRenamed("node", "first")
    classed = classes.join(linked, "first", "left").select("n", "f", "g", "__n", F.coalesce("component", "first").alias("component"))
    members = join_groups(can.select("doc_id", "n", "f", "g"), classed, ["n", "f", "g"], "__n")
    members = members.groupBy("doc_id").agg(F.min("component").alias("component"))
    known = sets.filter("doc_id IS NOT NULL").select("doc_id", "n")
    ids = materialise(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).join(members, "doc_id", "left"))
    out = join_groups(known, ids, ["doc_id"], "__n").select("doc_id", "n", "component")
    out = out.unionByName(sets.filter("doc_id IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
