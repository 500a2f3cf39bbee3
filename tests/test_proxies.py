"""Keyed state of proxies: shuffled batches and restarts against a plain loop."""

import json
import os
import random

import pytest

from coderill.streaming.proxies import READS, follow_proxies


def plain(reads, before):
    """UPGRADE and UNREAD rows of reads (address, block, implementation), proxy by proxy in order of block."""
    first = {}
    for address, block, found in reads:
        if first.get((address, block)) is None:
            first[address, block] = found
    known, out = dict(before), []
    for address, block in sorted(first):
        found, old = first[address, block], known.get(address)
        if found is None:
            out.append(("UNREAD", block, address, old, None))
        else:
            if old is not None and old != found:
                out.append(("UPGRADE", block, address, old, found))
            known[address] = found
    return sorted(out, key=repr)


def write(folder, number, rows, seen):
    lines = [json.dumps({"address": a, "block": b, "implementation": i, "seen": seen}) for a, b, i in rows]
    path = folder / f"{number:03}.json"
    path.write_text("\n".join(lines))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))  # files are read in order of time


def run(spark, tmp_path, name, before, late):
    frame = spark.createDataFrame(before, "address string, implementation string")
    reads = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    query = follow_proxies(reads, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint"), frame, late)
    assert query.awaitTermination(300)
    assert query.exception() is None
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).select("kind", "block", "address", "old_impl", "new_impl").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_and_restart(spark, tmp_path, seed):
    draw = random.Random(seed)
    reads = [(f"p{p}", block, draw.choice([None, "x", "y", "z"])) for p in range(12) for block in range(1, 11) if draw.random() < 0.7]
    before = [(f"p{p}", "x") for p in range(0, 12, 2)]
    want = plain(reads, before)
    assert {w[0] for w in want} == {"UPGRADE", "UNREAD"}
    draw.shuffle(reads)
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    parts = [reads[k::3] for k in range(3)]
    for k, part in enumerate(parts):
        write(tmp_path / "one", k, part + part[:4], 10 + k)  # some rows twice
    write(tmp_path / "one", 9, [(None, None, None)], 100)
    assert run(spark, tmp_path, "one", before, 12) == want
    for k, part in enumerate(parts):  # a restart after each batch
        write(tmp_path / "two", k, part, 10 + k)
        assert run(spark, tmp_path, "two", before, 12) == []
    write(tmp_path / "two", 9, [(None, None, None)], 100)
    assert run(spark, tmp_path, "two", before, 12) == want
    assert run(spark, tmp_path, "two", before, 12) == want


def test_late_reads_are_returned(spark, tmp_path):
    (tmp_path / "late").mkdir()
    write(tmp_path / "late", 0, [("p", 5, "x"), (None, None, None)], 5)
    run(spark, tmp_path, "late", [], 2)
    write(tmp_path / "late", 1, [("p", 9, "y")], 9)
    run(spark, tmp_path, "late", [], 2)
    write(tmp_path / "late", 2, [("p", 4, "w"), ("p", 5, "x"), ("p", 4, None)], 20)
    assert run(spark, tmp_path, "late", [], 2) == [("LATE", 4, "p", None, "w"), ("UPGRADE", 9, "p", "x", "y")]
