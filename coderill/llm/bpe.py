"""Byte-level BPE encoding and decoding.

A pre-token is merged with a priority queue of merge ranks over a doubly linked list of symbols: each
queue entry names a left position and the two symbols it saw there, and an entry whose symbols have
changed since is stale and skipped. Decoding concatenates vocabulary strings. Results are those of the
``tokenizers`` library for the same file without added special tokens; strings of special tokens that
stand in a text become their ids, as there.

Null and empty texts give no tokens and the hash of the empty string. Every row gives one row, repeated
rows and null ids included; other columns are dropped, so none can clash.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer pattern that byte-level vocabularies of this kind are made with.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens, and words, whose ids a worker remembers before it starts afresh: about 200 bytes each.
MEMORY = 800_000

_UNUSUAL_SPACE = re.compile(r"[^\S \n]|[ \n]{2}")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable Latin-1, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairCodec:
    """Encoder and decoder over the vocabulary and merges of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self._first = [vocabulary[c] for c in alphabet]
        self._span = 1 + max(vocabulary.values())
        self._merge: dict[int, tuple[int, int]] = {}  # pair of ids as one number: rank and joined id
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._merge[vocabulary[left] * self._span + vocabulary[right]] = rank << 32, vocabulary[left + right]
        self._bytes = {i: bytes(back[c] for c in token) for token, i in vocabulary.items()}
        self._special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self._bytes.update({i: text.encode() for text, i in self._special.items()})
        self.written = {str(i): data for i, data in self._bytes.items()}
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self._special, key=len, reverse=True)))) if self._special else None
        self.pre_tokens = regex.compile(PRE_TOKEN).findall

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token.

        A queue entry is a rank and a left position in one number. As a rank belongs to one pair of
        symbols, an entry is stale when the pair at its position has another rank by now, or none.
        """
        first = self._first
        symbols = [first[b] for b in data]
        n = len(symbols)
        if n < 2:
            return symbols
        find, span = self._merge.get, self._span
        queue = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if found := find(left * span + right):
                queue.append(found[0] | i - 1)
            left = right
        if not queue:
            return symbols
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            left = symbols[i]
            if j < 0 or left < 0:
                continue
            found = find(left * span + symbols[j])
            if found is None or found[0] | i != entry:
                continue  # stale: one of the two has been merged since
            joined = symbols[i] = found[1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := find(joined * span + symbols[k]):
                    heapq.heappush(queue, found[0] | i)
            h = before[i]
            if h >= 0 and (found := find(symbols[h] * span + joined)):
                heapq.heappush(queue, found[0] | h)
        return [x for x in symbols if x >= 0]

    def encode(self, text: str) -> list[int]:
        if not self.has_special(text):
            return [i for token in self.pre_tokens(text) for i in self.merge(token.encode("utf-8"))]
        out, at = [], 0
        for found in self._cut.finditer(text):
            out += self.encode(text[at : found.start()])
            out.append(self._special[found.group()])
            at = found.end()
        return out + self.encode(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")

    @staticmethod
    def text_of(data: bytes) -> bytes:
        """Joined vocabulary strings as UTF-8, with the replacement character for what is none."""
        return data.decode("utf-8", "replace").encode("utf-8")

    def has_special(self, text: str) -> bool:
        return self._cut is not None and self._cut.search(text) is not None


class _Tokens(dict):
    """Of a pre-token: its ids written with commas."""

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, token: str) -> str:
        out = ",".join(map(str, self.codec.merge(token.encode("utf-8"))))
        if len(token) <= 64:
            if len(self) > MEMORY:
                self.clear()
            self[token] = out
        return out


class _Words(dict):
    """The same of a word with what leads it: a space or nothing."""

    def __init__(self, tokens: _Tokens, lead: str):
        super().__init__()
        self.tokens, self.lead = tokens, lead

    def __missing__(self, word: str) -> str:
        tokens = self.tokens
        if word.isalpha():  # the commonest cases need no pattern
            out = tokens[self.lead + word]
        elif word[:-1].isalpha() and word[-1] in ",.":
            out = f"{tokens[self.lead + word[:-1]]},{tokens[word[-1]]}"
        else:
            out = ",".join([tokens[t] for t in tokens.codec.pre_tokens(self.lead + word)])
        if len(word) <= 64:
            if len(self) > MEMORY:
                self.clear()
            self[word] = out
        return out


class Digester:
    """Token count and the two hashes of a text.

    Where white space is single spaces and line feeds only, no pre-token spans more than a space and
    the word after it, so words are looked up one by one; other texts are encoded as a whole. The text's
    ids, as they are hashed, are decoded one by one.
    """

    def __init__(self, path: str):
        self.codec = BytePairCodec(path)
        self.tokens = _Tokens(self.codec)
        self.bare, self.spaced = _Words(self.tokens, ""), _Words(self.tokens, " ")

    def ids(self, text: str) -> str:
        if self.codec.has_special(text):
            return ",".join(map(str, self.codec.encode(text)))
        if _UNUSUAL_SPACE.search(text):
            tokens = self.tokens
            return ",".join([tokens[t] for t in self.codec.pre_tokens(text)])
        bare, spaced, out = self.bare, self.spaced, []
        feed = self.tokens["\n"]
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(feed)
            first, *rest = line.split(" ")
            if first:
                out.append(bare[first])
            out += [spaced[word] for word in rest]
        return ",".join(out)

    def digest(self, text: str) -> tuple[int, str, str]:
        ids = self.ids(text) if text else ""
        if not ids:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        each = ids.split(",")
        decoded = self.codec.text_of(b"".join(map(self.codec.written.__getitem__, each)))
        return len(each), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@functools.cache
def digester(path: str) -> Digester:
    """One for all tasks of a worker, with the words that it knows."""
    return Digester(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each whole text: (id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = digester(path).codec
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    frame = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return frame.mapInArrow(run, f"`{id_col}` {frame.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of each list of ids, special tokens included: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = digester(path).codec
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    frame = encoded.select(F.col(id_col), F.col(ids_col))
    return frame.mapInArrow(run, f"`{id_col}` {frame.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = digester(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                counts, ids, texts = [], [], []
                for text in part.column(1):
                    n, a, b = known.digest(text.as_py() or "")
                    counts.append(n), ids.append(a), texts.append(b)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    frame = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = frame.schema[0].dataType.simpleString()
    return frame.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
