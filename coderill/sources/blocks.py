"""``blocks``: a node's receipts as a streaming source, whose offset is the next block to read.

    spark.dataSource.register(BlockSource)
    spark.readStream.format("blocks").option("url", url).option("start", "100").load()

Options: ``url``; ``start`` (without it, the head when the query first starts); ``stop``, the last block; ``tasks``, how many
tasks share the blocks of a batch; ``most``, how many blocks a batch has at most; ``at``, the next block where the query goes on.
The head is polled once for each batch, and a node that answers with a lower one moves nothing back. An answer without a list of receipts fails the
batch, whose offset is then not committed. A block without receipts gives a row with a null one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from coderill.sources import rpc


class Blocks(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class BlockReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.tasks = options["url"], int(options.get("tasks", 8))
        self.start = int(options["start"]) if "start" in options else None
        self.stop = int(options["stop"]) if "stop" in options else None
        self.most = int(options["most"]) if "most" in options else None
        self.at = int(options["at"]) if "at" in options else self.start  # the greatest offset so far, where it is known

    def _moved(self, offset: int) -> dict:
        self.at = offset if self.at is None else max(self.at, offset)
        return {"next": self.at}

    def initialOffset(self) -> dict:
        return {"next": self._moved(rpc.head(self.url))["next"] if self.start is None else self.start}

    def latestOffset(self) -> dict:
        head = rpc.head(self.url)
        upto = (head if self.stop is None else min(head, self.stop)) + 1
        if self.at is None:
            return {"next": upto}
        return {"next": max(self.at, upto if self.most is None else min(upto, self.at + self.most))}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        first, stop = start["next"], end["next"]
        self._moved(stop)
        n = max(1, min(self.tasks, stop - first))
        edges = [first + max(0, stop - first) * k // n for k in range(n + 1)]
        return [Blocks(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        for block in range(partition.first, partition.stop):
            for receipt in rpc.receipts_of(self.url, block) or [None]:
                yield block, receipt

    def commit(self, end: dict) -> None:
        """Blocks can be read again at any time, so nothing is kept for that."""


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "block long, receipt string"

    def streamReader(self, schema) -> BlockReader:
        return BlockReader(self.options)
