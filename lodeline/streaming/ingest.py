"""Incremental ingest of a folder of files, and its progress."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.library import WORKING, Library, percent  # noqa: F401
from ..operators.staging import passing

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def latest(events: DataFrame, key: str, order: Column, keep: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*keep), order).alias("e")).select(key, "e.*")


def watch(library: Library, folder: str, checkpoint: str, collection: str = "") -> StreamingQuery:
    """Adds the files in ``folder`` that no earlier run has, then ends. A batch
    that is run again after a failure finds its files' hashes in the library, so
    nothing is added twice; what a broken run left pending is finished first."""
    spark = library.spark
    library.recover()
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def add(batch: DataFrame, _: int) -> None:
        with passing(spark):
            if not batch.isEmpty():
                library.add(batch, collection)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps the last events of runs: started, how many files a batch had, ended."""

    def __init__(self, most: int = 1000):
        self.events: deque[dict] = deque(maxlen=most)

    def onQueryStarted(self, event):
        self.events.append({"stage": "queued", "run": str(event.runId)})

    def onQueryProgress(self, event):
        self.events.append({"stage": "indexing", "run": str(event.progress.runId), "files": event.progress.numInputRows})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.events.append({"stage": "failed" if event.exception else "ready", "run": str(event.runId), "error": event.exception})


def document_progress(library: Library) -> DataFrame:
    """The library's documents with their state and the last stage told of each."""
    told = library.progress.select(F.col("document_id").alias("id"), "stage", "percent")
    return library.documents.select("id", "status", "error").join(told, "id", "left")


def session(spark: SparkSession, library: Library | None = None) -> dict:
    """What runs now, and how many documents of a library wait."""
    waiting = library.documents.filter(F.col("status").isin(*WORKING)).count() if library else 0
    return {"running": [q.name or str(q.id) for q in spark.streams.active], "pending": waiting}
