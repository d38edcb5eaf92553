"""Streams with state per key, kept in the RocksDB store beside the checkpoint.

A batch touches the state of its own keys only, so its cost does not grow with the stream's past, and
a replayed batch starts from the state before it. All rows of a key in one batch meet in one task.
Processors work on rows: a key has few in a batch, and building a data frame for each costs far more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; other streams keep their setting."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def nulls_last(*columns: str):
    """Sort key of rows."""
    return lambda row: [(row[c] is None, row[c]) for c in columns]


IN_ORDER = nulls_last("ts", "event_id")


class FirstSight(StatefulProcessor):
    """The first row of a key, once; of several in one batch the smallest in ``order``."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        least = min(rows, key=nulls_last(self.order))
        if not self.seen.exists():
            self.seen.update((True,))
            yield least

    def close(self) -> None:
        pass


class ShownPage(StatefulProcessor):
    """Results of a tab with ``stale``: the tab shows another page, or none, by then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.url = handle.getValueState("url", "url string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.url.get()
        shown = before = None if before is None else before[0]
        for event in sorted(rows, key=IN_ORDER):
            if event.kind == "result":
                yield Row(tab=key[0], event_id=event.event_id, url=event.url, stale=shown is None or event.url != shown)
            else:
                shown = event.url if event.kind == "navigate" else None
        if shown is not None and shown != before:
            self.url.update((shown,))
        elif shown is None and before is not None:
            self.url.clear()

    def close(self) -> None:
        pass


class LatestResult(StatefulProcessor):
    """The newest result for the page a tab shows, after each batch; a null event where there is none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "shown string, ts timestamp, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.shown.get()
        shown, ts, latest = (None, None, None) if before is None else before
        for event in sorted(rows, key=IN_ORDER):
            if event.kind != "result":
                shown, ts, latest = (event.url if event.kind == "navigate" else None), None, None
            elif shown is not None and event.url == shown:
                ts, latest = event.ts, event.event_id
        if shown is not None:
            self.shown.update((shown, ts, latest))
        elif before is not None:
            self.shown.clear()
        yield Row(tab=key[0], ts=ts, event_id=latest, url=shown if latest is not None else None)

    def close(self) -> None:
        pass


def by_key(stream: DataFrame, key: str, processor: StatefulProcessor, schema) -> DataFrame:
    return stream.groupBy(key).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None"
    )
