"""Implementations of proxies as keyed state of a stream of slot reads, in place of a join with all earlier reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

READS = "address string, block long, implementation string, seen long"
CHANGES = "kind string, block long, address string, old_impl string, new_impl string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settling(StatefulProcessor):
    """Of each proxy, the implementation that is known up to a block, and the reads after it.

    A read waits, with a timer at its block, until the watermark says that all reads of its block have come; then reads are settled
    in order of block. So state is what is known and what waits, not history.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._known = handle.getValueState("known", "block long, implementation string")
        self._waiting = handle.getMapState("waiting", "block long", "implementation string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._known.update((-1, initialState.implementation))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (address,) = key
        if address is None:  # a poll of the head, which only moves the watermark
            return
        settled, known = self._known.get() or (-1, None)
        for row in rows:
            if row.block <= settled:
                if row.implementation not in (None, known):
                    yield Row(kind="LATE", block=row.block, address=address, old_impl=None, new_impl=row.implementation)
                continue
            held = self._waiting.getValue((row.block,)) if self._waiting.containsKey((row.block,)) else None
            if held is None or held[0] is None:  # the first answer counts, and any answer before a failed read
                self._waiting.updateValue((row.block,), (row.implementation,))
                self._handle.registerTimer(row.block * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (address,) = key
        block = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if not self._waiting.containsKey((block,)):
            return
        settled, known = self._known.get() or (-1, None)
        (found,) = self._waiting.getValue((block,))
        self._waiting.removeKey((block,))
        if found is None:
            yield Row(kind="UNREAD", block=block, address=address, old_impl=known, new_impl=None)
        elif known is not None and found != known:
            yield Row(kind="UPGRADE", block=block, address=address, old_impl=known, new_impl=found)
        self._known.update((max(settled, block), known if found is None else found))


def settled(reads: DataFrame, before: DataFrame | None = None, late: int = 12) -> DataFrame:
    """Rows (kind, block, address, old_impl, new_impl) of a stream of ``READS``, once a block is ``late`` blocks behind the head.

    ``seen`` is the head of the chain when a row was delivered; a row without an address is a poll of the head. ``before`` is (address,
    implementation) as known when the stream starts. UPGRADE: another implementation follows a known one. UNREAD: the slot
    of that block could not be read, and is to be read again. LATE: a read of a block that is settled says otherwise; it is returned,
    so that ``ingest.changes`` of that proxy can be made anew from all its reads. Repeated reads change nothing.
    """
    rows = reads.withColumn("at", F.timestamp_seconds("seen")).withWatermark("at", f"{late} seconds")
    first = None if before is None else before.select("address", "implementation").groupBy("address")
    grouped = rows.select("address", "block", "implementation", "at").groupBy("address")
    return grouped.transformWithState(Settling(), CHANGES, "append", "EventTime", first)


def follow_proxies(reads: DataFrame, out: str, checkpoint: str, before: DataFrame | None = None, late: int = 12, every: str | None = None) -> StreamingQuery:
    """``settled`` as Parquet in ``out``: all reads so far, or with ``every`` those to come too. State is kept by RocksDB."""
    session = reads.sparkSession
    was = session.conf.get(PROVIDER)
    session.conf.set(PROVIDER, ROCKSDB)
    try:  # a query keeps the settings of its start
        writer = settled(reads, before, late).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(out)
    finally:
        session.conf.set(PROVIDER, was)
