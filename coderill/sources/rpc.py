"""JSON-RPC reads with retries, and Arrow-batched readers of receipts, codes and storage slots."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from coderill.functions.bytecode import BEACON_SLOT, IMPLEMENTATION_SLOT

Transport = Callable[[str, bytes], tuple[int, bytes]]


class RpcError(Exception):
    """An answer that is an error, or no answer after all retries. It never carries the URL."""


def post(url: str, body: bytes) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=30) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as error:
        return error.code, b""


def call(url: str, method: str, params: list, transport: Transport = post, retries: int = 5, sleep: Callable[[float], None] = time.sleep, retry_null: bool = False):
    """The result of a call; 429, 5xx, broken connections and (if asked) null are tried again after 1, 2, 4... seconds."""
    body = json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode()
    last = "no answer"
    for attempt in range(retries + 1):
        if attempt:
            sleep(2 ** (attempt - 1))
        try:
            status, data = transport(url, body)
        except OSError as error:
            last = type(error).__name__
            continue
        if status == 429 or status >= 500:
            last = f"status {status}"
            continue
        answer = json.loads(data)
        if "error" in answer:
            raise RpcError(f"{method}: {answer['error']}")
        if answer.get("result") is None and retry_null:
            last = "null result"
            continue
        return answer.get("result")
    raise RpcError(f"{method}: {last}")


def node_url(template: str, variable: str, env_file: str = ".env") -> str:
    """``template`` with the key that the environment, or else a line of a file, gives for ``variable``."""
    key = os.environ.get(variable) or ""
    if not key and os.path.isfile(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in map(str.strip, f):
                name, found, value = line.partition("=")
                if found and name == variable and not line.startswith("#"):
                    value = value.strip()
                    key = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
                    break
    if not key:
        raise RpcError(f"{variable} is not set")
    return template.format(key=key)


def _each(column: str, kind: str, workers: int, ask: Callable[[dict], str | None]) -> Callable[[DataFrame], DataFrame]:
    """Rows with one more column that ``ask`` gives of each; partitions are read side by side, and ``workers`` rows of a partition."""

    def fetch(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(workers) as pool:
                for batch in batches:
                    answers = list(pool.map(ask, batch.to_pylist()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, column])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{fields}, {column} {kind}")

    return fetch


def code_fetcher(url: str, transport: Transport = post, tag: str | None = "latest", workers: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A ``get_code`` for a batch; a failed read is a null answer. ``tag`` none asks for the code at the row's block."""

    def ask(row: dict) -> str | None:
        try:
            answer = call(url, "eth_getCode", [row["address"], tag or hex(row["block"])], transport)
        except (RpcError, ValueError):
            return None
        return answer if isinstance(answer, str) else None

    return _each("answer", "string", workers, ask)


def slot_fetcher(url: str, transport: Transport = post, tag: str | None = "latest", workers: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A ``get_slot`` for a batch; a failed read is a null word, and a word that is no text an empty one."""
    slots = {"implementation": f"0x{IMPLEMENTATION_SLOT}", "beacon": f"0x{BEACON_SLOT}"}

    def ask(row: dict) -> str | None:
        try:
            answer = call(url, "eth_getStorageAt", [row["address"], slots[row["slot"]], tag or hex(row["block"])], transport)
        except (RpcError, ValueError):
            return None
        return answer if isinstance(answer, str) else ""

    return _each("word", "string", workers, ask)


def head(url: str, transport: Transport = post) -> int:
    return int(call(url, "eth_blockNumber", [], transport), 16)


def receipts_of(url: str, block: int, transport: Transport = post, **options) -> list[str]:
    """A block's receipts as JSON texts; an answer that is no list is an error, not an empty block."""
    answer = call(url, "eth_getBlockReceipts", [hex(block)], transport, retry_null=True, **options)
    if not isinstance(answer, list):
        raise RpcError("eth_getBlockReceipts: no list")
    return [json.dumps(r) for r in answer]


def read_receipts(spark: SparkSession, url: str, blocks: range, transport: Transport = post) -> DataFrame:
    """(block, receipt) of some blocks, a block a task at a time; a block without receipts gives a row with a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                found = receipts_of(url, block, transport) or [None]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(found, pa.string())], names=["block", "receipt"])

    numbers = spark.range(blocks.start, blocks.stop, 1, max(1, min(len(blocks), 64)))
    return numbers.mapInArrow(run, "block long, receipt string")
