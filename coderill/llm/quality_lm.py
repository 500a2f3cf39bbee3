"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trusted texts are all labelled documents of good quality that are not toxic. Four in five train the model.

Tokens are words in the closed vocabulary of trusted words that occur ``LEAST_COUNT`` times or more; any other word is a class
by its shape (upper case, digits, symbols at its end or inside, length), so that the model sees how a text is
written, not which rare words it has. Counts of n-grams, their contexts' totals and their continuations
are DataFrames sharded by the hash of the context, and joined with one another into probabilities.

A model of at most ``BROADCAST_GRAMS`` n-grams is broadcast, and each text is scored where it lies. A larger one stays a
table: the logarithm of a text's probability is a sum over its n-grams, to which a seen n-gram adds what it differs from its
suffix by, and a seen context the weight of the lower order. Bigrams are counted and asked for as in ``bigram_table``, where no
text is shuffled; with other orders, chunks of documents ask for what their keys add, each once, as in ``exchange``.

A document goes if its
log perplexity, less the mean of its language and over the deviation that texts of its length have, is over the
``QUANTILE`` of this number among the fifth of trusted texts that is held out. Mean, deviation (a part that all texts
have, and one that falls with the square root of the number of tokens) and quantile are learned from all of these texts, by sums
and counts, for each language with at least ``LEAST`` of them, and for all together.

Null and empty texts have one token, the end, and a null perplexity; they are kept here. Rows keep their
number; null ids and null languages are scored like others. Repeated rows of an id are one trusted text. Without
trusted texts, or held-out ones, everything is kept. Columns of any name are kept by ``accepted`` and dropped by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coderill.llm import bigram_table, exchange, words, worker
from coderill.llm.bigram_table import FREQUENT, Dealt
from coderill.llm.bigram_table import discounts as _discounts
from coderill.llm.tables import BROADCAST_GROUPS, join_groups, materialise, shards, stored
from coderill.llm.word_shapes import hashed

#: N-grams of a model that is broadcast, at most.
BROADCAST_GRAMS = 2_000_000
LEAST_COUNT = 5
ORDER = 3
#: Order of the classifier: trigrams of all trusted texts are twice the rows, and tell no more bad texts.
BIGRAMS = 2
LEAST = 30
QUANTILE = 0.995

_U = np.uint64
_START, _END = _U(0xA11CE5), _U(0xE9D5)
_ROLL = _U(0x9FB21C651E98DF25)

def token_keys(hashes: np.ndarray, shape: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)
    return np.where(known, hashes, shape)


def streams(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all documents with two starts before and an end after each, and where documents begin."""
    n = len(counts)
    firsts = np.cumsum(counts) - counts
    out = np.insert(keys, np.repeat(firsts, 2), _START) if n else keys
    sizes = counts + 2
    out = np.insert(out, np.cumsum(sizes), _END) if n else out
    sizes = sizes + 1
    return out, np.concatenate(([0], np.cumsum(sizes)))


def ngram_keys(stream: np.ndarray, order: int) -> np.ndarray:
    """Key of the ``order`` tokens that end at each place from ``order - 1`` on."""
    out = np.zeros(max(0, len(stream) - order + 1), dtype=np.uint64)
    for j in range(order):
        out = out * _ROLL + stream[j : len(stream) - order + 1 + j]
    return words.mix(out + _U(order))


class Model(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order from 1: sorted keys, discounted share
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by order from 1: sorted context keys, weight of the lower order
    uniform: float

    def log_probabilities(self, stream: np.ndarray) -> np.ndarray:
        """Natural logarithm for each place of a stream; places of starts mean nothing."""

        def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
            known, values = table
            if not len(known):
                return np.full(len(keys), missing)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return np.where(known[at] == keys, values[at], missing)

        p = look(self.grams[0], ngram_keys(stream, 1), 0.0) + self.contexts[0][1][0] * self.uniform
        for order in range(2, len(self.grams) + 1):
            lower = p[order - 1 :]
            share = look(self.grams[order - 1], ngram_keys(stream, order), 0.0)
            back = look(self.contexts[order - 1], ngram_keys(stream[:-1], order - 1), 1.0)
            p = np.concatenate((p[: order - 1], share + back * lower))
        return np.log(p)


COUNTED = "k int, key long, context long, suffix long, n long"


def _train_counts(texts: DataFrame, vocabulary: np.ndarray, order: int) -> DataFrame:
    """N-grams of all orders in the training texts, with the keys of their context and of their suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {k: [] for k in range(1, order + 1)}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                if parts:
                    rows = np.concatenate(parts, axis=1)
                    distinct, first, n = np.unique(rows[0], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(distinct), k, np.int32)), *(pa.array(rows[r][first].view(np.int64)) for r in range(3)), pa.array(n.astype(np.int64))],
                        names=["k", "key", "context", "suffix", "n"],
                    )
                    parts.clear()

        for batch in batches:
            for _, counts, hashes, shape in hashed(batch.column(0)):
                stream, bounds = streams(token_keys(hashes, shape, vocabulary), counts)
                begin = np.zeros(len(stream), dtype=np.int64)
                begin[bounds[:-1]] = 1
                place = np.arange(len(stream)) - bounds[np.cumsum(begin) - 1]
                for k in range(1, order + 1):
                    keep = place[k - 1 :] >= max(2, k - 1)  # the predicted token is no start
                    held[k].append(np.stack([ngram_keys(stream, k), _before(stream, k), _after(stream, k)])[:, keep])
                if sum(x.shape[1] for x in held[1]) > 2_000_000:
                    yield from flush()
        yield from flush()

    parts = texts.select("text").mapInArrow(worker.tidy(run), COUNTED)
    return parts.groupBy("k", "key").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


def _before(stream: np.ndarray, k: int) -> np.ndarray:
    return ngram_keys(stream[:-1], k - 1) if k > 1 else np.zeros(len(stream), np.uint64)


def _after(stream: np.ndarray, k: int) -> np.ndarray:
    return ngram_keys(stream[1:], k - 1) if k > 1 else np.zeros(len(stream), np.uint64)


def _orders(counted: DataFrame, order: int) -> Iterator[tuple[DataFrame, Column, DataFrame]]:
    """For each order the n-grams (key, context, suffix, n), what is cut from their counts, and totals of contexts; lower orders with their continuations."""
    for k in range(1, order + 1):
        own = counted.filter(F.col("k") == k).select("key", "context", "suffix", "n")
        if k < order:  # lower orders count the distinct tokens before them
            more = counted.filter(F.col("k") == k + 1).groupBy(F.col("suffix").alias("of")).agg(F.count(F.lit(1)).alias("before"))
            own = own.join(more, own["key"] == more["of"], "left").select("key", "context", "suffix", F.coalesce("before", "n").alias("n"))
        of_counts = {r["n"]: r["c"] for r in own.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
        d1, d2, d3 = _discounts(of_counts)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        yield own, cut, materialise(own.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"), F.count(F.lit(1)).alias("__n")))


def train(texts: DataFrame, vocabulary: np.ndarray, order: int = ORDER) -> Model:
    """Sharded count joins: n-grams with their contexts' totals; the model is gathered."""
    return _gathered(materialise(_train_counts(texts, vocabulary, order)), vocabulary, order)


def _gathered(counted: DataFrame, vocabulary: np.ndarray, order: int) -> Model:
    grams, contexts = [], []
    for own, cut, totals in _orders(counted, order):
        joined = join_groups(own, totals, ["context"], "__n")
        rows = joined.select("key", ((F.col("n") - cut) / F.col("total")).alias("share")).orderBy("key").toArrow()
        back = totals.select("context", (F.col("freed") / F.col("total")).alias("weight")).orderBy("context").toArrow()
        grams.append(_table(rows))
        contexts.append(_table(back))
    return Model(vocabulary, grams, contexts, 1 / (len(grams[0][0]) + 1))


@dataclass
class Grams(Dealt):
    """A model of any order in a table by buckets of keys: what the n-gram or context of a key adds to the logarithm of a text's probability."""

    vocabulary: np.ndarray  # sorted word hashes
    added: DataFrame  # bucket int, keys binary, added binary
    buckets: int
    unseen: float  # logarithm of the probability of an unseen word
    order: int

    def perplexities(self, docs: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
        return dealt_perplexities(docs, self, text_col).select(F.struct(*(F.col(f"row.`{c}`") for c in columns)).alias("row"), "log", "n")


def deal(counted: DataFrame, vocabulary: np.ndarray, buckets: int, order: int = ORDER) -> Grams:
    """The model of counted n-grams as a table: no row of it passes the driver."""
    parts, lower, unseen = [], None, 0.0
    for k, (own, cut, totals) in enumerate(_orders(counted, order), 1):
        n, weight = F.col("n"), (F.col("freed") / F.col("total")).alias("weight")
        if lower is None:  # words have one context
            of = totals.first()
            flat = of["freed"] / of["total"] / (of["__n"] + 1)
            unseen = float(np.log(flat))
            rows = own.select("key", "n", F.log((n - cut) / F.lit(of["total"]) + flat).alias("log")).withColumn("added", F.col("log") - unseen)
        else:
            joined = join_groups(own, totals.select("context", "total", weight, "__n"), ["context"], "__n").drop("__n")
            # a lower order's count is how many n-grams have it as their suffix
            below = lower.select(F.col("key").alias("suffix"), F.col("log").alias("below"), F.col("n").alias("__n"))
            rows = join_groups(joined, below, ["suffix"], "__n").withColumn("log", F.log((n - cut) / F.col("total") + F.col("weight") * F.exp("below")))
            rows = rows.select("key", "n", "log", (F.col("log") - F.log("weight") - F.col("below")).alias("added"))
            parts.append(totals.select(F.col("context").alias("key"), F.log(weight).alias("added")))
        lower = stored(rows) if k < order else rows
        parts.append(lower.select("key", "added"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            keys, added = _summed(*(np.concatenate(x) for x in zip(*held)))
            cuts = exchange.cuts(keys, buckets)
            rows = [(b, keys[lo:hi], added[lo:hi]) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, *_ in rows], pa.int32()), pa.array([exchange._pack_keys(k) for _, k, _ in rows], pa.binary()), pa.array([x.astype(np.float32).tobytes() for *_, x in rows], pa.binary())], names=["bucket", "keys", "added"])

    return Grams(vocabulary, stored(whole.mapInArrow(worker.tidy(pack), "bucket int, keys binary, added binary")), buckets, unseen, order)


def _summed(keys: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order with the sums of what they add: an n-gram may be a context too."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=added, minlength=len(distinct))


def _keys(texts: pa.ChunkedArray, vocabulary: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, distinct keys of all of their n-grams, and for each n-gram its key's place there and its text."""
    counts, keys, owners, done = [], [], [], 0
    for _, own, hashes, shape in hashed(texts):
        stream, bounds = streams(token_keys(hashes, shape, vocabulary), own)
        owner = np.repeat(np.arange(len(own)), np.diff(bounds))
        place = np.arange(len(stream)) - bounds[owner]
        for k in range(1, order + 1):
            keep = place[k - 1 :] >= max(1, k - 1)  # from the second start on: it is a context
            keys.append(ngram_keys(stream, k)[keep])
            owners.append((owner[k - 1 :][keep] + done).astype(np.int32))
        counts.append(own)
        done += len(own)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))
    return np.concatenate(counts) if counts else np.zeros(0, np.int64), distinct, at, np.concatenate(owners) if owners else np.zeros(0, np.int32)


ANSWER = "chunk int, bucket int, added binary"


def _answers(asked: pa.Table, model: pa.Table) -> pa.Table:
    """What the keys of each request add, in their order: nothing where the model has none."""
    known, added = _summed(*(np.concatenate(x) for x in ([exchange._unpack_keys(k) for k in model["keys"].to_pylist()], [np.frombuffer(x, np.float32) for x in model["added"].to_pylist()]))) if model.num_rows else (np.zeros(0, _U), np.zeros(0))

    def look(keys: np.ndarray) -> bytes:
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        out = np.where(known[at] == keys, added[at], 0.0) if len(known) else np.zeros(len(keys))
        return exchange.pack_counts(out.astype(np.float32).view(np.uint32))

    return pa.table({"chunk": asked["chunk"].cast(pa.int32()), "bucket": asked["bucket"].cast(pa.int32()), "added": pa.array([look(exchange._unpack_keys(k)) for k in asked["keys"].to_pylist()], pa.binary())})


def dealt_perplexities(docs: DataFrame, model: Grams, text_col: str = "text") -> DataFrame:
    """(row, log, n): rows of ``docs`` as a struct, their log perplexity and number of tokens, by request and answer."""
    chunks = shards(docs, text_col, 8 << 20)
    chunked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), exchange.chunk_of(chunks).alias("chunk"))
    held = docs.sparkSession.sparkContext.broadcast(model.vocabulary)
    buckets, order, unseen = model.buckets, model.order, model.unseen
    at = docs.columns.index(text_col)

    def texts(table: pa.Table) -> pa.Array:
        rows = table["row"].combine_chunks()
        return (rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows).field(at)

    def ask(table: pa.Table) -> pa.Table:
        _, distinct, _, _ = _keys(texts(table), held.value, order)
        return exchange.requests(table["chunk"][0].as_py(), distinct, np.zeros(len(distinct), np.int64), buckets)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"row": table["row"], "log": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        counts, distinct, place, owner = _keys(texts(table), held.value, order)
        added, cuts = np.zeros(len(distinct), np.float32), exchange.cuts(distinct, buckets)
        for b, data in zip(answers["bucket"].to_pylist(), answers["added"].to_pylist()):
            added[cuts[b] : cuts[b + 1]] = exchange.unpack_counts(data, cuts[b + 1] - cuts[b]).astype(np.uint32).view(np.float32)
        sizes = counts + 1
        logs = -(np.bincount(owner, weights=added[place].astype(float), minlength=len(counts)) / sizes + unseen)
        return pa.table({"row": table["row"], "log": pa.array(logs), "n": pa.array(sizes.astype(np.int64))})

    asked = chunked.groupBy("chunk").applyInArrow(ask, exchange.REQUEST)
    answers = asked.groupBy("bucket").cogroup(model.added.groupBy("bucket")).applyInArrow(_answers, ANSWER)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("log", T.DoubleType()), T.StructField("n", T.LongType())])
    return exchange.with_answers(chunked, answers, score, schema)


def _table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = rows.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return np.ascontiguousarray(keys[order]), np.ascontiguousarray(rows.column(1).to_numpy()[order])


def vocabulary_of(texts: DataFrame, least: int = LEAST_COUNT) -> np.ndarray:
    return bigram_table.word_counts(texts, least, 8)[0]


class Bound(NamedTuple):
    """Log perplexities of trusted texts: their mean, the variance that all have and that over the number of tokens, and the quantile."""

    mean: float
    shared: float
    per_token: float
    quantile: float

    def exceeded(self, logs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (logs - self.mean) / np.sqrt(self.shared + self.per_token / np.maximum(sizes, 1)) > self.quantile


def _spread(n: float, over: float, over2: float, squares: float, cross: float, alike: bool) -> tuple[float, float]:
    """Squared deviations as a line over one over the length, from their sums: neither part is below zero."""
    a, b = squares / n, 0.0
    if n > 2 and not alike:
        b = (n * cross - over * squares) / (n * over2 - over * over)
        a = (squares - b * over) / n
    if a <= 0:  # all of it by length
        a, b = 0.0, cross / over2
    if b <= 0:
        a, b = squares / n, 0.0
    return max(float(a), 1e-9), max(float(b), 0.0)


def bound_of(logs: np.ndarray, sizes: np.ndarray, quantile: float = QUANTILE) -> Bound:
    """The bound of texts that are at hand."""
    mean = float(np.average(logs, weights=sizes))
    squares, over = (logs - mean) ** 2, 1 / sizes
    shared, per_token = _spread(len(logs), over.sum(), (over * over).sum(), squares.sum(), (squares * over).sum(), np.ptp(over) == 0)
    return Bound(mean, shared, per_token, float(np.quantile((logs - mean) / np.sqrt(shared + per_token * over), quantile)))


#: Cells of a standardised number for the search of its quantile: of a hundredth, from -``_FAR`` to ``_FAR``.
_FAR = 50


def bounds_of(found: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> dict[str | None, Bound]:
    """The bounds of texts (lang, log, n): of each language that has ``least`` of them, and of all; sums and counts are gathered, and no text."""
    all_of = F.array(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("of")))
    own = F.array(F.struct(F.lit(False).alias("every"), F.col("lang").alias("of")))
    rows = found.filter("n > 1").select("log", "n", F.explode(F.when(F.col("lang").isNull(), all_of).otherwise(F.concat(all_of, own))).alias("g")).select("g.every", "g.of", "log", "n")
    means = rows.groupBy("every", "of").agg(F.count(F.lit(1)).alias("count"), (F.sum(F.col("log") * F.col("n")) / F.sum("n")).alias("mean")).filter(F.col("every") | (F.col("count") >= least)).collect()
    if not means:
        return {}
    named = lambda r: None if r["every"] else r["of"]
    same = F.col("of").eqNullSafe(F.col("__of")) & (F.col("every") == F.col("__every"))

    def beside(values: dict[str | None, tuple], columns: str) -> DataFrame:
        """Rows with values of their language."""
        table = found.sparkSession.createDataFrame([(x is None, x, *v) for x, v in values.items()], f"__every boolean, __of string, {columns}")
        return rows.join(F.broadcast(table), same)

    mean = {named(r): r["mean"] for r in means}
    squares, over = (F.col("log") - F.col("mean")) ** 2, 1 / F.col("n")
    sums = beside({x: (m,) for x, m in mean.items()}, "mean double").groupBy("every", "of").agg(
        F.count(F.lit(1)).alias("count"), F.sum(over).alias("over"), F.sum(over * over).alias("over2"), F.sum(squares).alias("squares"), F.sum(squares * over).alias("cross"), (F.max("n") == F.min("n")).alias("alike")
    )
    count, spread = {}, {}
    for r in sums.collect():
        count[named(r)], spread[named(r)] = r["count"], _spread(r["count"], r["over"], r["over2"], r["squares"], r["cross"], r["alike"])
    z = ((F.col("log") - F.col("mean")) / F.sqrt(F.col("shared") + F.col("per_token") / F.col("n"))).alias("z")
    scaled = beside({x: (mean[x], *spread[x]) for x in mean}, "mean double, shared double, per_token double").select("every", "of", z)
    scaled = stored(scaled.withColumn("cell", F.floor(F.least(F.greatest("z", F.lit(-_FAR)), F.lit(_FAR)) * 100).cast("int")))
    cells: dict[str | None, list[tuple[int, int]]] = {x: [] for x in mean}
    for r in scaled.groupBy("every", "of", "cell").agg(F.count(F.lit(1)).alias("c")).orderBy("cell").collect():  # at most 200 * _FAR + 1 each
        cells[named(r)].append((r["cell"], r["c"]))
    wanted, before = [], {}
    for x, held in cells.items():
        ends, rank = np.cumsum([c for _, c in held]), quantile * (count[x] - 1)
        lo, hi = (int(np.searchsorted(ends, r, side="right")) for r in (int(rank), min(int(rank) + 1, count[x] - 1)))
        before[x] = int(ends[lo - 1]) if lo else 0
        wanted += [(x is None, x, cell) for cell in {held[lo][0], held[hi][0]}]
    at = found.sparkSession.createDataFrame(wanted, "__every boolean, __of string, __cell int")
    near = scaled.join(F.broadcast(at), same & (F.col("cell") == F.col("__cell")))
    values: dict[str | None, list[tuple[float, int]]] = {x: [] for x in mean}
    for r in near.groupBy("every", "of", "z").agg(F.count(F.lit(1)).alias("c")).orderBy("z").collect():
        values[named(r)].append((r["z"], r["c"]))
    out = {}
    for x, held in values.items():
        ends, rank = before[x] + np.cumsum([c for _, c in held]), quantile * (count[x] - 1)
        lo, hi = (held[int(np.searchsorted(ends, r, side="right"))][0] for r in (int(rank), min(int(rank) + 1, count[x] - 1)))
        out[x] = Bound(mean[x], *spread[x], float(lo + (rank - int(rank)) * (hi - lo)))
    return out


class Classifier(NamedTuple):
    model: Model | Dealt | None
    bounds: dict[str | None, Bound]  # by language; None: of all

    def score(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", log_col: str = "log_perplexity", kept_col: str = "kept") -> DataFrame:
        """``docs`` with two more columns, whose names must be free: log perplexity, and whether the document is kept."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        if self.model is None:
            return docs.select("*", F.lit(None).cast("double").alias(log_col), F.lit(True).alias(kept_col))
        if isinstance(self.model, Dealt):
            return self._asked(docs, docs.columns, text_col, lang_col, log_col, kept_col)
        held = docs.sparkSession.sparkContext.broadcast((self.model, self.bounds))
        at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None
        names = [*docs.columns, log_col, kept_col]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, bounds = held.value
            for batch in words.slices(batches, text_col, 1 << 20):  # some text at a time beside the model
                logs, sizes = log_perplexities(model, batch.column(at))
                langs = np.array([x if x in bounds else None for x in batch.column(lang_at).to_pylist()] if lang_at is not None else [None] * batch.num_rows, dtype=object)
                gone = np.zeros(batch.num_rows, dtype=bool)
                for lang, bound in bounds.items():
                    mine = langs == lang
                    gone[mine] = bound.exceeded(logs[mine], sizes[mine])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, mask=sizes <= 1), pa.array(~gone | (sizes <= 1))], names=names)

        return docs.mapInArrow(worker.tidy(run), f"{fields}, `{log_col}` double, `{kept_col}` boolean")

    def _asked(self, docs: DataFrame, columns: list[str], text_col: str, lang_col: str, log_col: str, kept_col: str) -> DataFrame:
        """``columns``, the language's among them, with the verdict of a model that stays a table."""
        found, some = self.model.perplexities(docs, text_col, columns), F.col("n") > 1
        lang = F.col(f"row.`{lang_col}`") if lang_col in docs.columns else F.lit(None).cast("string")
        gone = F.lit(False)
        for x, bound in self.bounds.items():
            over = (F.col("log") - bound.mean) / F.sqrt(F.lit(bound.shared) + F.lit(bound.per_token) / F.col("n")) > bound.quantile
            mine = F.coalesce(~lang.isin([b for b in self.bounds if b is not None]), F.lit(True)) if x is None else F.coalesce(lang == x, F.lit(False))
            gone = gone | (mine & over)
        return found.select("row.*", F.when(some, F.col("log")).alias(log_col), (~gone | ~some).alias(kept_col))

    def accepted(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
        """The rows of ``docs`` that are kept, with all their columns, whatever their names."""
        free = lambda c: next(f"__{c}{k}" for k in range(len(docs.columns) + 1) if f"__{c}{k}" not in docs.columns)
        log_col, kept_col, a, b = free("log"), free("kept"), free("a"), free("b")
        if not isinstance(self.model, Dealt):
            return self.score(docs, text_col, lang_col, log_col, kept_col).filter(F.col(kept_col)).drop(log_col, kept_col)
        # a verdict follows from text and language, so two hashes of them name the texts that go, and no text travels
        lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
        text = F.col(f"`{text_col}`").cast("string")
        one, two = (F.xxhash64(F.lit(k), lang.isNull(), lang, text.isNull(), text) for k in (1, 2))
        named = docs.select(one.alias(a), two.alias(b), lang.alias("lang"), text.alias("text"))
        gone = stored(self._asked(named, [a, b, "lang"], "text", "lang", log_col, kept_col).filter(~F.col(kept_col)).select(a, b).distinct())
        few = gone.count() <= BROADCAST_GROUPS
        return docs.join(F.broadcast(gone) if few else gone, (one == F.col(a)) & (two == F.col(b)), "left_anti")


def log_perplexities(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative logarithm of a token's probability, and the number of tokens, of each text."""
    logs, sizes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for lo, counts, hashes, shape in hashed(texts):
        stream, bounds = streams(token_keys(hashes, shape, model.vocabulary), counts)
        found = model.log_probabilities(stream)
        found[bounds[:-1]] = found[bounds[:-1] + 1] = 0  # starts
        sizes[lo : lo + len(counts)] = counts + 1
        logs[lo : lo + len(counts)] = -np.add.reduceat(found, bounds[:-1]) / (counts + 1)
    return logs, sizes


def shares(counts: list[int], most: int) -> list[int]:
    """How many of each to take, up to an equal share, what small ones leave going to the others; ``most`` in all."""
    out = [0] * len(counts)
    left = most
    for k, i in enumerate(sorted(range(len(counts)), key=lambda i: counts[i])):
        out[i] = min(counts[i], left // (len(counts) - k))
        left -= out[i]
    return out


def _trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(__id, text, lang) of all trusted ids; of several rows of an id, the least. Only rows of such ids are shuffled."""
    ids = trusted.select(F.col("__label"))
    if ids.count() > BROADCAST_GROUPS:
        found = docs.join(ids, F.col("__id") == F.col("__label"), "left_semi").filter("text IS NOT NULL")
        return stored(found.groupBy("__id").agg(F.min(F.struct("text", "lang")).alias("r")).select("__id", "r.text", "r.lang"))
    found = docs.join(F.broadcast(ids), F.col("__id") == F.col("__label"), "left_semi")
    several = stored(found.groupBy("__id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("__id").alias("__several")))
    found = found.filter("text IS NOT NULL")
    if several.isEmpty():
        return found
    same = F.col("__id") == F.col("__several")
    least = found.join(F.broadcast(several), same, "left_semi").groupBy("__id").agg(F.min(F.struct("text", "lang")).alias("r")).select("__id", "r.text", "r.lang")
    return found.join(F.broadcast(several), same, "left_anti").unionByName(stored(least))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = BIGRAMS, broadcast_grams: int = BROADCAST_GRAMS, frequent: int = FREQUENT) -> Classifier:
    """The model and the bounds from all trusted documents; a model of more than ``broadcast_grams`` n-grams stays a table."""
    trusted = labels.filter("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("__label")).distinct()
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"), lang.cast("string").alias("lang"))
    held = _trusted(rows, trusted).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(5)))
    training, kept = held.filter("part > 0"), held.filter("part = 0").select("text", "lang")
    buckets = shards(training, "text")
    vocabulary, counts = bigram_table.word_counts(training, LEAST_COUNT, buckets)
    dealt = None
    if order == BIGRAMS:
        table = bigram_table.counted(training, vocabulary, counts, buckets)
        if table.n == 0:
            return Classifier(None, {})
        if table.n + table.words > broadcast_grams:
            dealt = bigram_table.smoothed(table, frequent)
    else:
        grams = stored(_train_counts(training, vocabulary, order))
        if (n := grams.count()) == 0:
            return Classifier(None, {})
        if n > broadcast_grams:
            dealt = deal(grams, vocabulary, buckets, order)
    if dealt is not None:
        return Classifier(dealt, bounds_of(stored(dealt.perplexities(kept, "text", ["lang"]).select("row.lang", "log", "n"))))
    model = train(training, vocabulary, order)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", 1 << 20):
            logs, sizes = log_perplexities(shared.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(logs), pa.array(sizes)], names=["lang", "log", "n"])

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return Classifier(model, bounds_of(stored(kept.mapInArrow(worker.tidy(scored), "lang string, log double, n long"))))


def judge(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, log_perplexity, kept) for each row of ``docs``."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    frame = docs.select(F.col(id_col), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    if isinstance(classifier.model, Dealt):
        return classifier._asked(frame, [id_col, "lang"], "text", "lang", "log_perplexity", "kept")
    return classifier.score(frame).select(id_col, "lang", "log_perplexity", "kept")
