"""Language-model scores by deleted interpolation of a bigram model.

The probability of a token is a mixture of three maximum-likelihood estimates: of the token after its
context, of the token alone, and of any of ``V + 1`` tokens alike. The weights depend on how often the
context was seen, in buckets by powers of two. They are learned by expectation-maximisation on held-out
counts: every training token in turn is deleted from the counts that predict it, which leaves one less
in its bigram, its context and its word.

Counts of words and bigrams are made over the whole training corpus by ``exchange``: each chunk of
documents asks for its distinct keys, so common words are one entry of each chunk. For the weights,
deleted estimates meet in cells of close values, at most ``_CELLS`` squared for each bucket, of which
the counts and sums are exact.

Tokens are the words of the text with A-Z lower-cased, then one end. A null or empty text is one end
token. Rows keep their number. A null id is in the training part and stays null. Extra columns are
dropped. Without training text, N and V are 0 and every token has the probability of the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.llm import exchange, words
from coderill.llm.tables import materialise, shards

HELD_OUT_OF = 7
HELD_OUT = 2
ROUNDS = 50
_CELLS = 160
_BUCKETS = 40

_U = np.uint64
_START = _U(0x5AFE5EED00000001)
_END = _U(0x5AFE5EED00000002)
_PAIR = _U(0xC2B2AE3D27D4EB4F)


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each document, and the hashes of all tokens and of their contexts."""
    counts, current, context = [], [], []
    for w in words.split_words(texts):
        ends = np.cumsum(w.counts)
        current.append(np.insert(w.hashes, ends, _END))
        context.append(np.insert(w.hashes, ends - w.counts, _START))
        counts.append(w.counts + 1)
    if not counts:
        none = np.zeros(0, dtype=np.uint64)
        return np.zeros(0, dtype=np.int64), none, none
    return np.concatenate(counts), np.concatenate(current), np.concatenate(context)


def bigram_keys(current: np.ndarray, context: np.ndarray) -> np.ndarray:
    return words.mix(context * _PAIR + current)


def _asked(table: pa.Table, chunks: int) -> pa.Table:
    counts, current, context = tokens(table["text"])
    train = np.repeat(~table["held_out"].to_numpy(), counts)
    chunk = table["chunk"][0].as_py()
    out = []
    for base, keys in ((0, current), (chunks, bigram_keys(current, context))):
        distinct, at = np.unique(keys, return_inverse=True)
        out.append(exchange.requests(chunk, distinct, np.bincount(at, weights=train, minlength=len(distinct)).astype(np.int64), chunks, base))
    return pa.concat_tables(out)


COUNTED = "doc_id long, held_out boolean, n_tokens long, words binary, pairs binary, n_keys long, n_counted long"


def _counted(table: pa.Table, answers: pa.Table, chunks: int) -> pa.Table:
    """Of each document, the corpus counts of its tokens and of its bigrams; sums of answers on a row of each chunk."""
    counts, current, context = tokens(table["text"])
    distinct, at = np.unique(current, return_inverse=True)
    word = exchange.answered(answers, distinct, chunks)[at]
    bigrams, there = np.unique(bigram_keys(current, context), return_inverse=True)
    pair = exchange.answered(answers, bigrams, chunks, chunks)[there]
    ends = np.cumsum(counts).tolist()
    spans = list(zip([0, *ends], ends))
    own = answers["bucket"].to_numpy() < chunks
    sums = [int(answers[c].to_numpy()[own].sum()) for c in ("n_keys", "n_counted")]
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "held_out": table["held_out"],
            "n_tokens": pa.array(counts.astype(np.int64)),
            "words": pa.array([exchange.pack_counts(word[a:b]) for a, b in spans], pa.binary()),
            "pairs": pa.array([exchange.pack_counts(pair[a:b]) for a, b in spans], pa.binary()),
            **{c: pa.array([x] + [0] * (len(counts) - 1), pa.int64()) for c, x in zip(("n_keys", "n_counted"), sums)},
        }
    ) if len(counts) else pa.table({f.name: pa.array([], f.type) for f in _SCHEMA})


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), ("n_keys", pa.int64()), ("n_counted", pa.int64())])


def _opened(batch: pa.RecordBatch, starts: int) -> tuple[np.ndarray, ...]:
    """Tokens of each document of a batch of COUNTED, and of all tokens the counts of bigram, context and word."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    counts = column("n_tokens").to_numpy()
    word, pair = (np.concatenate([exchange.unpack_counts(x, n) for x, n in zip(column(c).to_pylist(), counts.tolist())]) for c in ("words", "pairs"))
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(counts) - counts] = starts
    return counts, pair, context, word


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 plus the whole part of its binary logarithm."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], _BUCKETS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else a quarter of a power of two."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + np.floor(-4 * np.log2(np.maximum(p, 1e-300))), 1, _CELLS - 1), 0).astype(np.int64)


CELLS = "bucket int, cell int, n long, p2 double, p1 double"


def _deleted(batch: pa.RecordBatch, starts: int, total: int) -> pa.RecordBatch:
    counts, pair, context, word = _opened(batch, starts)
    train = np.repeat(~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False), counts)
    pair, context, word = pair[train] - 1, context[train] - 1, word[train] - 1
    p2 = pair / np.maximum(context, 1)
    p1 = word / max(total - 1, 1)
    key = (_bucket(context) * _CELLS + _cell(p2)) * _CELLS + _cell(p1)
    cells, at = np.unique(key, return_inverse=True)
    columns = [
        pa.array((cells // _CELLS**2).astype(np.int32)),
        pa.array((cells % _CELLS**2).astype(np.int32)),
        pa.array(np.bincount(at, minlength=len(cells)).astype(np.int64)),
        pa.array(np.bincount(at, weights=p2, minlength=len(cells)).astype(float)),
        pa.array(np.bincount(at, weights=p1, minlength=len(cells)).astype(float)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "cell", "n", "p2", "p1"])


def learn_weights(bucket: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket by expectation-maximisation over the cells."""
    weights = np.full((_BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5  # a context never seen predicts nothing
    p = np.stack([p2, p1, np.full(len(n), p0)], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, k], minlength=_BUCKETS) for k in range(3)], axis=1)
        seen = new.sum(axis=1) > 0
        weights[seen] = np.maximum(new[seen] / new[seen].sum(axis=1, keepdims=True), [0, 1e-9, 1e-9])
        weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    plain = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False)).alias("held_out"),
    )
    chunks = shards(plain, "text")
    chunked = plain.withColumn("chunk", exchange.chunk_of(chunks))
    asked = chunked.groupBy("chunk").applyInArrow(lambda table: _asked(table, chunks), exchange.REQUEST)
    # one job, so that requests and answers read the same exchange of texts; from here on only counts are read
    counted = exchange.with_answers(chunked, exchange.totals(asked), lambda a, b: _counted(a, b, chunks), COUNTED.replace("doc_id long", f"doc_id {kind}"))
    counted = materialise(counted)
    sums = counted.agg(F.sum("n_counted"), F.sum("n_keys"), F.count_if(~F.col("held_out"))).first()
    total, distinct, starts = (x or 0 for x in sums)

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_deleted(part, starts, total) for batch in batches for part in _parts(batch))

    cells = counted.select("held_out", "n_tokens", "words", "pairs").mapInArrow(deleted, CELLS)
    cells = cells.groupBy("bucket", "cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
    rows = cells.orderBy("bucket", "cell").collect()  # at most _BUCKETS * _CELLS ** 2
    bucket, n, p2, p1 = (np.array([r[k] for r in rows]) for k in ("bucket", "n", "p2", "p1"))
    p0 = 1 / (distinct + 1)
    weights = learn_weights(bucket.astype(int), n, p2 / np.maximum(n, 1), p1 / np.maximum(n, 1), p0) if len(rows) else np.tile([0, 0, 1.0], (_BUCKETS, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _parts(batch)):
            counts, pair, context, word = _opened(part, starts)
            mix = weights[_bucket(context)]
            p = mix[:, 0] * (pair / np.maximum(context, 1)) + mix[:, 1] * (word / max(total, 1)) + mix[:, 2] * p0
            firsts = np.cumsum(counts) - counts  # every document has its end token
            columns = [
                part.column(0), part.column(1), part.column(2),
                pa.array(np.add.reduceat((word > 0).astype(np.int64), firsts)),
                pa.array(np.full(len(counts), total, dtype=np.int64)),
                pa.array(np.add.reduceat(np.log10((word + 1) / (total + distinct + 1)), firsts)),
                pa.array(np.add.reduceat(np.log10(p), firsts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCORES.split(", ")])

    out = counted.select("doc_id", "held_out", "n_tokens", "words", "pairs").mapInArrow(run, SCORES.replace("doc_id long", f"doc_id {kind}"))
    return out.withColumnRenamed("doc_id", id_col)


def _parts(batch: pa.RecordBatch, tokens_each: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch of COUNTED in parts of about so many tokens."""
    so_far = np.cumsum(batch.column(batch.schema.get_field_index("n_tokens")).to_numpy())
    lo = 0
    while lo < batch.num_rows:
        before = int(so_far[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(so_far, before + tokens_each, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
