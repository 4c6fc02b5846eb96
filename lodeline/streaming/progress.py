"""The progress of documents as a stream with a state for each.

Stages are told in any order and may be told again; the state of a document is the
last of them by time. A document that has neither ended nor been told of for a while
is reported as stuck by a timer, and is as it was when it is told of again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.library import TABLES, Library

ENDS = ("ready", "failed")
STATE = "stage string, percent int, at bigint"
OUT = f"document_id bigint, {STATE}, stuck boolean"
#: Seconds without news after which a document is stuck.
PATIENCE = 900
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stages(StatefulProcessor):
    """Keeps the last stage of a document; null percents count as less than
    any. Without ``patience`` there are no timers."""

    def __init__(self, patience: float | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def _row(self, key, state, stuck: bool) -> pd.DataFrame:
        return pd.DataFrame({"document_id": [key[0]], "stage": [state[0]], "percent": pd.array([state[1]], "Int32"), "at": [state[2]], "stuck": [stuck]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        order = lambda s: (s[2], -1 if s[1] is None else s[1], s[0])
        told = ((r.stage, None if pd.isna(r.percent) else int(r.percent), int(r.at)) for part in rows for r in part.itertuples())
        state = max([max(told, key=order), *([before] if before else [])], key=order)
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state[0] not in ENDS:
                self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + self.patience * 1000))
        if state != before:
            self.last.update(state)
            yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self._row(key, tuple(self.last.get()), True)

    def close(self) -> None:
        pass


def stages(events: DataFrame, patience: float | None = None) -> DataFrame:
    """(document_id, stage, percent, at, stuck) whenever a document's state
    changes, of events (document_id, stage, percent, at), streaming or not.
    ``patience``: seconds, of a stream that goes on; one that ends when all is
    read has no time to wait."""
    session = events.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.streams.active  # noqa: B018  starts what state stores report to, for tables too
    keyed = events.select("document_id", "stage", "percent", "at").groupBy("document_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Stages(patience), outputStructType=OUT, outputMode="Update", timeMode="None" if patience is None else "ProcessingTime")


def follow(library: Library, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str | None = None, patience: float = PATIENCE) -> StreamingQuery:
    """Follows a library's progress; ``sink`` gets each batch of changed states
    and its number. ``every``: the time between batches of a query that goes
    on and reports stuck documents; without it, it ends when all is read."""
    events = library.spark.readStream.schema(TABLES["progress"]).parquet(f"{library.path}/progress")
    writer = stages(events, patience if every else None).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
