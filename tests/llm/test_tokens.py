"""Random strings against the tokenizers library, decoded ids, and packing of odd inputs."""

import hashlib
import random

import numpy as np
import pytest

from coderill.llm import bpe, packing
from coderill.llm.queries import vocabulary

#: Characters where lower-casing, marks, signs, spaces and scripts meet.
ODD = "aZé ßẞİıſΣσςǅŉẖΐ́̇​­'’\".,;|-_#0½²٣日本한ำ🙂  　\x1c\x1f\t\n\r\x85"


def strings(seed, n, longest=12):
    rng = random.Random(seed)
    plain = [chr(c) for c in range(32, 0x250)] + [chr(rng.randrange(0x250, 0x3000)) for _ in range(400)] + [chr(rng.randrange(0x3000, 0x1FFFF)) for _ in range(200)]
    out = []
    for k in range(n):
        pool = (ODD, "".join(plain), ODD[:30] + " .")[k % 3]
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(1, longest))))
    return [s for s in out if not any(0xD800 <= ord(c) < 0xE000 for c in s)]


def test_packing_ids_of_random_strings():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), packing.WordIds(path)
    texts = [f"{a}{sign}" for a in ("İ", "ßİ", "İß", "é", "ŉ", "ẞ", "ΑΣ", "aİb") for sign in ("", ".", "|", "...", "'", ".a")] + strings(5, 9000) + strings(6, 300, 200)
    wrong = [t for t, got in zip(texts, ours.encode(texts)) if got != np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert not wrong


def test_bpe_of_random_strings():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), bpe.Digester(path)
    for text in strings(7, 6000) + strings(8, 200, 300) + ["", " ", "\n", "<|endoftext|>", "a<|endoftext|>", "x" * 50_000, "ab " * 50_000]:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert ours.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_decoding_concatenates_vocabulary_strings():
    path = vocabulary("byte_bpe_50k.json")
    codec = bpe.BytePairCodec(path)
    assert codec.decode(codec.encode("naïve 日本 🙂")) == "naïve 日本 🙂" and codec.decode([]) == ""
    half = codec.encode("🙂")[:1]
    assert codec.decode(half) == "�" and bpe.BytePairCodec.text_of(b"\xf0\x9f") == "�".encode()


def test_empty_tables_clashing_names_and_very_long_texts(spark):
    schema = "doc_id long, text string, piece int, length long, ids array<int>, n_tokens long, sequence_id long, salt int, rank int"
    long = "word and " * 400_000
    rows = [(1, long, 0, 0, None, 0, 0, 0, 0), (1, None, 0, 0, None, 0, 0, 0, 0), (None, "", 0, 0, None, 0, 0, 0, 0)]
    frame = spark.createDataFrame(rows, schema)
    digested = bpe.round_trip(frame, vocabulary("byte_bpe_50k.json"))
    assert digested.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in digested.collect())
    assert got == [(0, 0, hashlib.sha256(b"").hexdigest()), (1, 0, hashlib.sha256(b"").hexdigest()), (1, 800_001, hashlib.sha256(long.encode()).hexdigest())]
    assert bpe.round_trip(frame.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
    packed = packing.pack(packing.tokenise(frame, vocabulary("word_bpe_49k.json")))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = packed.collect()
    assert sum(r.length for r in pieces) == 800_001 + 1 + 1 and len({r.sequence_id for r in pieces}) == -(-800_003 // 4096)
    assert packing.pack(packing.tokenise(frame.limit(0), vocabulary("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plans_are_near_the_lower_bound(seed):
    """Random sizes: never above the sequences that first-fit in falling order takes."""
    rng = np.random.default_rng(seed)
    items = [int(x) for x in rng.integers(1, 101, size=400)]
    bins: list[int] = []
    for size in sorted(items, reverse=True):
        at = next((i for i, used in enumerate(bins) if used + size <= 100), None)
        if at is None:
            bins.append(size)
        else:
            bins[at] += size
    sizes = {s: items.count(s) for s in set(items)}
    assert packing.Plan(sizes, 100).bins <= len(bins)
