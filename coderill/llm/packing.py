"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Large-item matching: items above a third of the capacity fit at most two to a bin, so the largest is
matched greedily with the largest one that still fits beside it; smaller items then go, in falling
order, each to the fullest bin with room.

Only sizes matter for where an item goes, and there are at most ``capacity`` of them. So the plan is made
on the histogram of sizes (bounded by the capacity, whatever the input), with whole runs of equal items
placed into runs of equal bins, and each item finds its bin from its rank among the items of its size.
Ranks come from two levels of counts, so that a size that many items share is no single task.

Null and empty texts are a piece of one end token. Repeated rows are packed as often as they come, and a
null id is kept. Other columns are dropped, so none can clash.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coderill.llm import worker
from coderill.llm.tables import materialise

CAPACITY = 4096
END_TOKEN = 1

#: Distinct words whose ids a worker remembers: about 200 bytes each. Those of the older half are forgotten
#: together, unless they were met again.
MEMORY = 600_000

_BATCH = 20_000

#: ASCII signs, without the apostrophe, which may belong to what follows it.
_SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

_NOT_UNICODE_SPACE = re.compile("[\x1c-\x1f]")


class WordIds:
    """Ids of texts under a tokenizer that never joins what white space parts, word by word.

    Where the tokenizer marks the ends of words and parts letters from signs, a new word of letters and signs
    at its end is put together from both; its letters are encoded beside other words' in one text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.parted = int(self.ends[self.tokenizer.encode("a.", add_special_tokens=False).ids].sum()) == 2
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > MEMORY // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        split = [None if _NOT_UNICODE_SPACE.search(text) else text.split() for text in texts]
        missing = set().union(*(words for words in split if words)).difference(known)
        known.update((word, older[word]) for word in missing if word in older)
        self._learn([word for word in missing if word not in older])
        find = known.__getitem__
        return [self._bytes(text) if words is None else b"".join(map(find, words)) for text, words in zip(texts, split)]


    def _learn(self, fresh: list[str]) -> None:
        known, whole, signs = self.known, [], {}
        joined = "\n".join(fresh)
        special = any(token in joined for token in self.added)
        parted: list[tuple[str, str, str]] = []
        for word in fresh:
            head = word.rstrip(_SIGNS)
            # lower-casing may part a letter into a letter and a mark, which is encoded as a sign
            plain = head.isascii()
            if not self.parted or not head.isalpha() or not (plain or head.lower().isalpha()) or special and any(token in word for token in self.added):
                whole.append(word)
                continue
            tail = word[len(head) :]
            if tail and tail not in signs:
                signs[tail] = self._bytes(tail)
            parted.append((word, head.lower() if plain else head, tail))
        heads = {head: known[head] for _, head, _ in parted if head in known}
        self._letters(list({head for _, head, _ in parted} - heads.keys()), heads)
        for word, head, tail in parted:
            known[word] = heads[head] + signs[tail] if tail else heads[head]
        for lo in range(0, len(whole), _BATCH):
            some = whole[lo : lo + _BATCH]
            for word, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                ids = got.ids
                known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, heads: list[str], out: dict[str, bytes]) -> None:
        """Words of letters alone, each of which ends once; where one does not, they are encoded one by one."""
        groups = [heads[lo : lo + 200] for lo in range(0, len(heads), 200)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(group) for group in groups], add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(group) or ends[-1] != 4 * len(ids):
                out.update((head, self._bytes(head)) for head in group)
                continue
            raw, at = ids.tobytes(), 0
            for head, to in zip(group, ends.tolist()):
                out[head] = raw[at:to]
                at = to


def word_ids(path: str) -> WordIds:
    """One encoder for all tasks of a worker, with the words that it knows."""
    return worker.kept(f"words of {path}", lambda: WordIds(path))


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document: (id, piece, start, length, ids_crc32); only longer documents are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = word_ids(path), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows: list[tuple[int, int, int, int, int]] = []
                for i, ids in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += stop
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((i, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *(pa.array(cols[k]) for k in (2, 3, 4))],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    frame = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return frame.mapInArrow(worker.tidy(run, forgetting=False), f"`{id_col}` {frame.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where items of each size go: runs of ranks, each into a run of bins, ``per_bin`` to a bin."""

    def __init__(self, sizes: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # size, first rank, first bin, per bin, offset
        self._placed: dict[int, int] = {}
        self._gaps: list[int] = []
        self._open: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, bins)
        left = {s: n for s, n in sizes.items() if n > 0}
        assert all(0 < s <= capacity for s in left), "pieces are no longer than the capacity"
        self._match_large(left)
        for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
            self._best_fit(size, left[size])

    def _put(self, size: int, n: int, first: int, per_bin: int, offset: int) -> None:
        rank = self._placed.get(size, 0)
        self.runs.append((size, rank, first, per_bin, offset))
        self._placed[size] = rank + n

    def _opened(self, gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in self._open:
            bisect.insort(self._gaps, gap)
            self._open[gap] = []
        self._open[gap].append((first, n))

    def _match_large(self, left: dict[int, int]) -> None:
        large = sorted(s for s in left if 3 * s > self.capacity)
        rest = {s: left[s] for s in large}
        while large:
            size = large[-1]
            k = bisect.bisect_right(large, self.capacity - size) - 1
            partner = large[k] if k >= 0 else 0
            if partner == size and rest[size] == 1:
                partner = large[k - 1] if k else 0
            first = self.bins
            if not partner:
                n = rest[size]
                self._put(size, n, first, 1, 0)
            elif partner == size:
                n = rest[size] // 2
                self._put(size, 2 * n, first, 2, 0)
                rest[size] -= n
            else:
                n = min(rest[size], rest[partner])
                self._put(size, n, first, 1, 0)
                self._put(partner, n, first, 1, size)
                rest[partner] -= n
            rest[size] -= n
            self.bins += n
            self._opened(self.capacity - size - partner, first, n)
            large = [s for s in large if rest[s] > 0]

    def _best_fit(self, size: int, n: int) -> None:
        while n:
            k = bisect.bisect_left(self._gaps, size)
            if k == len(self._gaps):
                self._opened(self.capacity, self.bins, -(-n // (self.capacity // size)))
                self.bins += -(-n // (self.capacity // size))
                continue
            gap = self._gaps[k]
            first, bins = self._open[gap].pop()
            if not self._open[gap]:
                del self._open[gap], self._gaps[k]
            each, offset = gap // size, self.capacity - gap
            full = min(bins, n // each)
            if full:
                self._put(size, full * each, first, each, offset)
                self._opened(gap - each * size, first, full)
                n -= full * each
                first, bins = first + full, bins - full
            if n and bins:  # fewer than a bin takes are left
                self._put(size, n, first, n, offset)
                self._opened(gap - n * size, first, 1)
                first, bins, n = first + 1, bins - 1, 0
            self._opened(gap, first, bins)

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = np.array(self.runs or np.zeros((0, 5)), dtype=np.int64)
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        return tuple(np.ascontiguousarray(runs[:, k]) for k in range(5))


def ranked(pieces: DataFrame, order: list[str], per_group: int = 50_000) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, 2... among the pieces of a length, in no matter which order."""
    groups = max(16, 1 << (pieces.count() // per_group).bit_length())
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy(*order)
    return salted.withColumn("within", F.row_number().over(within) - 1).join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("within")).drop("salt", "within", "first")


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32) with their sequence_id and offset."""
    pieces = materialise(pieces)
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each size
    plan = pieces.sparkSession.sparkContext.broadcast(Plan(sizes, capacity).arrays())
    out = ranked(pieces, [id_col, "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rank, first, each, offset = plan.value
        step = int(rank.max()) + 1 if len(rank) else 1
        keys = size * step + rank if step < 1 << 50 else None
        assert keys is not None, "ranks are too large for the search key"
        for batch in batches:
            lengths = batch.column(names.index("length")).to_numpy()
            ranks = batch.column(names.index("rank")).to_numpy()
            # a rank beyond the last run's first rank still belongs to that run
            k = np.searchsorted(keys, lengths * step + np.minimum(ranks, step - 1), side="right") - 1
            at = ranks - rank[k]
            columns = [batch.column(names.index(c)) for c in names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first[k] + at // each[k]), pa.array(offset[k] + at % each[k] * lengths)],
                names=[*(c for c in names if c != "rank"), "sequence_id", "offset"],
            )

    names = out.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "rank")
    return out.mapInArrow(run, f"{kept}, sequence_id long, offset long").select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
