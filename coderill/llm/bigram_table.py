"""A Kneser-Ney bigram model of any size: packed counts in a table, and texts that ask it for what their bigrams add.

Words of the vocabulary have numbers by falling count, shapes of other words the numbers after, so a bigram is one exact integer.
Tasks count the bigrams of their texts and send each once to its bucket, in rising order, as compressed
differences; a bucket is one row of the table. What the model knows of single words (the total and the weight of a context,
the probability of a word) is 24 bytes a word, and goes to all tasks with the vocabulary and the ``FREQUENT`` most frequent bigrams.

A text is scored where it is read: what single words and frequent bigrams add is summed at once. Its other bigrams
go with the text's place in its chunk to their buckets, where what they add is summed by text, and only these sums
return to the chunk. So no text is shuffled, and no bucket is hot: bigrams that many trusted texts have are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from coderill.llm import exchange, words, worker
from coderill.llm.tables import stored
from coderill.llm.word_shapes import SHAPES, hashed, shape_numbers

#: Bigrams that go to all tasks, at most: 12 bytes each.
FREQUENT = 1_000_000
#: Texts of a chunk at most, and its bytes.
CHUNK, CHUNK_BYTES = 1 << 12, 1 << 23
#: Tokens that a task holds before it sends their bigrams on.
_HELD = 2_000_000
#: Word numbers of a row of statistics.
_RANGE = 1 << 16

_U = np.uint64


class Dealt:
    """A model that stays a table."""

    def perplexities(self, docs: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
        """(row, log, n): the ``columns`` of each row as a struct, its log perplexity and number of tokens."""
        raise NotImplementedError


def discounts(of_counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
    n1, n2, n3, n4 = (of_counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]


class _Index:
    """Places in rising keys that are spread evenly, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.n, bits = len(keys), max(1, len(keys).bit_length())
        self.keys, self.shift = np.append(keys, _U(0xFFFFFFFFFFFFFFFF)), _U(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        at = self.starts[x >> self.shift]
        left = np.flatnonzero(self.keys[at] < x)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < x[left]]
        return np.where((self.keys[at] == x) & (at < self.n), at, -1)


COUNTED = "bucket int, keys binary, counts binary, n long"


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts rising keys by bucket, still rising in each, and where buckets begin and end; ``buckets`` is a power of two."""
    of = words.mix(keys) >> _U(65 - buckets.bit_length())
    of = of.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def _rows(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of COUNTED for distinct keys in rising order."""
    order, cuts = _by_bucket(keys, buckets)
    keys, counts = keys[order], counts[order]
    spans = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
    columns = [
        pa.array([b for b, *_ in spans], pa.int32()),
        pa.array([exchange._pack_keys(keys[lo:hi], "zstd") for _, lo, hi in spans], pa.binary()),
        pa.array([exchange.pack_counts(counts[lo:hi]) for _, lo, hi in spans], pa.binary()),
        pa.array([int(hi - lo) for _, lo, hi in spans], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "counts", "n"])


def _opened(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = exchange._unpack_keys(keys, "zstd")
    return found, exchange.unpack_counts(counts, len(found))


def _summed(parts: DataFrame, least: int = 1) -> DataFrame:
    """One row of COUNTED for each bucket: its keys that are counted ``least`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate(x) for x in zip(*(_opened(k, c) for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist()))))
        keys, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        keys, total = keys[total >= least], total[total >= least]
        return pa.table({"bucket": table["bucket"][:1].cast(pa.int32()), "keys": pa.array([exchange._pack_keys(keys, "zstd")], pa.binary()), "counts": pa.array([exchange.pack_counts(total)], pa.binary()), "n": pa.array([len(keys)], pa.int64())})

    return parts.groupBy("bucket").applyInArrow(run, COUNTED)


def word_counts(texts: DataFrame, least: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in rising order, and counts, of the words that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in words.slices(batches, "text", CHUNK_BYTES):
            held += [hashes for _, _, hashes, _ in hashed(batch.column(0))]
            if sum(map(len, held)) > _HELD:
                yield _rows(*np.unique(np.concatenate(held), return_counts=True), buckets)
                held = []
        if held:
            yield _rows(*np.unique(np.concatenate(held), return_counts=True), buckets)

    found = _summed(texts.select("text").mapInArrow(worker.tidy(run), COUNTED), least).toArrow()
    parts = [_opened(k, c) for k, c in zip(found["keys"].to_pylist(), found["counts"].to_pylist())]
    keys, counts = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, _U), np.zeros(0, np.int64))
    order = np.argsort(keys)
    return keys[order], counts[order]


class Lexicon(NamedTuple):
    hashes: np.ndarray  # of words, rising
    numbers: np.ndarray  # of these words, by falling count

    @property
    def start(self) -> int:
        return len(self.hashes) + SHAPES

    @property
    def size(self) -> int:
        """Words, shapes, the start and the end of a text."""
        return self.start + 2


class _Reader:
    """Contexts, words and texts of the bigrams in texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.index = lexicon, _Index(lexicon.hashes)

    def read(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of texts: first row, words of each text, and the contexts and words of their bigrams."""
        known = self.lexicon.numbers if len(self.lexicon.numbers) else np.zeros(1, np.int32)
        for lo, counts, hashes, shape in hashed(texts, shape_numbers):
            at = self.index.find(hashes)
            numbers = np.where(at >= 0, known[at], shape + len(self.lexicon.hashes))
            ends = np.cumsum(counts)
            yield lo, counts, np.insert(numbers, ends - counts, self.lexicon.start), np.insert(numbers, ends, self.lexicon.start + 1)


class Counts(NamedTuple):
    lexicon: Lexicon
    table: DataFrame  # COUNTED, a row for each bucket; a key is context * size + word
    buckets: int
    n: int  # bigrams
    words: int  # that any of them ends with
    of_words: np.ndarray  # by number: total, how often counted 1, 2, 3 or more as context; bigrams that end with it
    cells: np.ndarray  # bigrams by cell of their count


def _cell(n: np.ndarray) -> np.ndarray:
    """Counts as they are up to 4096, then sixteen cells for each power of two."""
    return np.where(n < 4096, n, 4096 + np.floor(16 * (np.log2(np.maximum(n, 1)) - 12))).astype(np.int64)


_CELLS = 4096 + 16 * 52


def counted(texts: DataFrame, vocabulary: np.ndarray, counts: np.ndarray, buckets: int) -> Counts:
    """The bigrams of all texts by bucket, and sums of them by word."""
    numbers = np.empty(len(vocabulary), np.int32)
    numbers[np.argsort(-counts, kind="stable")] = np.arange(len(vocabulary), dtype=np.int32)
    lexicon = Lexicon(vocabulary, numbers)
    size = lexicon.size
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = _Reader(shared.value), []
        for batch in words.slices(batches, "text", CHUNK_BYTES):
            held += [context.astype(np.uint64) * _U(size) + word.astype(np.uint64) for _, _, context, word in reader.read(batch.column(0))]
            if sum(map(len, held)) > _HELD:
                yield _rows(*np.unique(np.concatenate(held), return_counts=True), buckets)
                held = []
        if held:
            yield _rows(*np.unique(np.concatenate(held), return_counts=True), buckets)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, cells = np.zeros((5, size), np.int64), np.zeros(_CELLS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = _opened(row["keys"], row["counts"])
                context, word = (x.astype(np.int64) for x in np.divmod(keys, _U(size)))
                of_words[0] += np.bincount(context, weights=n, minlength=size).astype(np.int64)
                for k, mine in enumerate((n == 1, n == 2, n > 2), 1):
                    of_words[k] += np.bincount(context[mine], minlength=size)
                of_words[4] += np.bincount(word, minlength=size)
                cells += np.bincount(_cell(n), minlength=_CELLS)
        parts = [(-1, cells), *((lo // _RANGE, of_words[:, lo : lo + _RANGE].ravel()) for lo in range(0, size, _RANGE))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([exchange.pack_counts(x) for _, x in parts], pa.binary()), pa.array([len(x) for _, x in parts], pa.int64())], names=["part", "sums", "n"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(exchange.unpack_counts(x, n) for x, n in zip(table["sums"].to_pylist(), table["n"].to_pylist()))
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "sums": pa.array([exchange.pack_counts(total)], pa.binary()), "n": pa.array([len(total)], pa.int64())})

    table = stored(_summed(texts.select("text").mapInArrow(worker.tidy(run), COUNTED)))
    schema = "part int, sums binary, n long"
    found = table.mapInArrow(worker.tidy(sums), schema).groupBy("part").applyInArrow(added, schema).collect()
    by = {r["part"]: exchange.unpack_counts(bytes(r["sums"]), r["n"]) for r in found}
    cells = by.pop(-1, np.zeros(_CELLS, np.int64))
    of_words = np.concatenate([by[k].reshape(5, -1) for k in sorted(by)], axis=1) if by else np.zeros((5, size), np.int64)
    return Counts(lexicon, table, buckets, int(cells.sum()), int((of_words[4] > 0).sum()), of_words, cells)


class Known(NamedTuple):
    """What all tasks have of the model."""

    lexicon: Lexicon
    log: np.ndarray  # logarithm of a word's own probability, by number
    seen: np.ndarray  # whether a bigram ends with it
    total: np.ndarray  # of a context
    weight: np.ndarray  # of the lower order after it; 1 after what is no context
    cuts: tuple[float, float, float]
    frequent: np.ndarray  # mixed keys, rising
    added: np.ndarray  # what these bigrams add

    def adds(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How much likelier a bigram of this count makes a text than its word alone, after the context's weight."""
        context, word = (x.astype(np.int64) for x in np.divmod(keys, _U(self.lexicon.size)))
        left = n - np.array([0.0, *self.cuts])[np.minimum(n, 3)]
        weight, log = self.weight[context].astype(float), self.log[word].astype(float)
        return (np.log(left / self.total[context] + weight * np.exp(log)) - np.log(weight) - log).astype(np.float32)


def smoothed(counts: Counts, frequent: int = FREQUENT) -> Bigrams:
    """Modified Kneser-Ney from the counts; ``frequent`` bigrams at most go to all tasks."""
    total, ones, twos, more, before = counts.of_words
    cuts = discounts({i: int(counts.cells[i]) for i in (1, 2, 3, 4)})
    freed = ones * cuts[0] + twos * cuts[1] + more * cuts[2]
    below = discounts({i: int((before == i).sum()) for i in (1, 2, 3, 4)})
    cut = np.array([0.0, *below])[np.minimum(before, 3)]
    flat = cut.sum() / before.sum() / (counts.words + 1)
    log = np.log((before - cut) / before.sum() + flat)
    weight = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
    none = np.zeros(0, _U), np.zeros(0, np.float32)
    known = Known(counts.lexicon, log.astype(np.float32), before > 0, total.astype(np.float32), weight.astype(np.float32), tuple(cuts), *none)
    upper = np.cumsum(counts.cells[::-1])[::-1]  # bigrams of this cell or a higher one
    least = int(np.argmax(np.append(upper, 0) <= frequent))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = _opened(row["keys"], row["counts"])
                mine = _cell(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[mine].view(np.int64)), pa.array(n[mine])], names=["key", "n"])

    if upper[least:].any():
        found = counts.table.mapInArrow(worker.tidy(often), "key long, n long").toArrow()
        keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
        mixed = words.mix(keys)
        order = np.argsort(mixed)
        known = known._replace(frequent=mixed[order], added=known.adds(keys, n)[order])
    return Bigrams(counts.table, counts.buckets, known)


ASKED = "bucket int, chunk long, head binary, a binary, b binary"
ANSWER = "chunk long, head binary, a binary, b binary"
_NAMES = ["bucket", "chunk", "head", "a", "b"]


class Bigrams(Dealt):
    def __init__(self, table: DataFrame, buckets: int, known: Known):
        self.table, self.buckets, self.known = table, buckets, known

    def perplexities(self, docs: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
        from pyspark.sql import functions as F

        buckets = self.buckets
        shared = docs.sparkSession.sparkContext.broadcast(self.known)
        most = min(CHUNK, 1 << max(0, 63 - 2 * self.known.lexicon.size.bit_length()))  # a bigram and a place are one integer
        bits = _U(most.bit_length() - 1)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            chunk, known = TaskContext.get().partitionId() << 32, shared.value
            reader, frequent, size = _Reader(known.lexicon), _Index(known.frequent), _U(known.lexicon.size)
            alone = known.log, np.log(known.weight)
            for batch in words.slices(batches, "text", CHUNK_BYTES):
                for at in range(0, batch.num_rows, most):
                    yield _asked(batch.slice(at, most), chunk, reader, frequent, size, alone, known)
                    chunk += 1

        def _asked(batch: pa.RecordBatch, chunk: int, reader: _Reader, frequent: _Index, size: np.uint64, alone: tuple[np.ndarray, np.ndarray], known: Known) -> pa.RecordBatch:
            logs, sizes, rare = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), []
            for lo, counts, context, word in reader.read(batch.column(1)):
                hi = lo + len(counts)
                owner = np.repeat(np.arange(lo, hi), counts + 1)
                adds = (alone[0][word] + alone[1][context]).astype(float)
                keys = context.astype(np.uint64) * size + word.astype(np.uint64)
                found = frequent.find(words.mix(keys))
                often = found >= 0
                adds[often] += known.added[found[often]]
                logs[lo:hi] = np.bincount(owner - lo, weights=adds, minlength=hi - lo)
                sizes[lo:hi] = counts + 1
                asks = ~often & known.seen[word] & (known.total[context] > 0)
                rare.append(keys[asks] << bits | owner[asks].astype(np.uint64))
            asked = np.sort(np.concatenate(rare)) if rare else np.zeros(0, _U)
            order, cuts = _by_bucket(asked >> bits, buckets)
            asked = asked[order]
            spans = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([batch.schema.field(0)])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column(0)], schema=pa.schema([batch.schema.field(0)])))
            head = [buckets + chunk % buckets, chunk, pa.compress(sink.getvalue(), codec="zstd", asbytes=True), logs.tobytes(), sizes.tobytes()]
            rows = [head, *([b, chunk, None, exchange._pack_keys(asked[lo:hi], "zstd"), None] for b, lo, hi in spans)]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            head[2] = len(sink.getvalue()).to_bytes(8, "little") + head[2]
            return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)], names=_NAMES)

        def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
            """For each chunk that asks, its texts to which the bucket adds something, and how much."""
            if not asked.num_rows or asked["bucket"][0].as_py() >= buckets:
                return pa.table({c: asked[c].cast(pa.int64() if c == "chunk" else pa.binary()) for c in _NAMES[1:]})
            keys, n = _opened(model["keys"][0].as_py(), model["counts"][0].as_py()) if model.num_rows else (np.zeros(0, _U), np.zeros(0, np.int64))
            added, keys = np.append(shared.value.adds(keys, n), np.float32(0)), np.append(keys, _U(0xFFFFFFFFFFFFFFFF))
            places, sums = [], []
            for data in asked["a"]:
                x = exchange._unpack_keys(data.as_py(), "zstd")
                mine = x >> bits
                at = np.searchsorted(keys, mine)
                found = keys[at] == mine
                total = np.bincount((x[found] & _U(most - 1)).astype(np.int64), weights=added[at[found]])
                some = np.flatnonzero(total)
                places.append(exchange._pack_keys(some.astype(np.uint64), "zstd"))
                sums.append(total[some].astype(np.float32).tobytes())
            return pa.table({"chunk": asked["chunk"].cast(pa.int64()), "head": pa.nulls(len(sums), pa.binary()), "a": pa.array(places, pa.binary()), "b": pa.array(sums, pa.binary())})

        def ended(table: pa.Table) -> pa.Table:
            row, logs, sizes = None, None, None
            rest = []
            for head, a, b in zip(table["head"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist()):
                if head is None:
                    rest.append((exchange._unpack_keys(a, "zstd").astype(np.int64), np.frombuffer(b, np.float32)))
                else:
                    held = pa.decompress(head[8:], int.from_bytes(head[:8], "little"), codec="zstd", asbytes=True)
                    row, logs, sizes = pa.ipc.open_stream(held).read_all()["row"], np.frombuffer(a).copy(), np.frombuffer(b, np.int64)
            for places, sums in rest:
                logs[places] += sums
            return pa.table({"row": row, "log": pa.array(-logs / sizes), "n": pa.array(sizes)})

        row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
        frame = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
        asked = frame.mapInArrow(worker.tidy(ask), ASKED)
        answers = asked.groupBy("bucket").cogroup(self.table.groupBy("bucket")).applyInArrow(answer, ANSWER)
        schema = T.StructType([frame.schema["row"], T.StructField("log", T.DoubleType()), T.StructField("n", T.LongType())])
        return answers.groupBy("chunk").applyInArrow(ended, schema)
