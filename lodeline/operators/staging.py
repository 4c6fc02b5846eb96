"""Intermediate tables on the storage that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A session on one machine that
    names none gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        found = tempfile.mkdtemp(prefix="lodeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_held = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What this thread stores inside is removed at the end; for work whose
    result lies elsewhere by then."""
    outer, _held.paths = getattr(_held, "paths", None), []
    try:
        yield
    finally:
        mine, _held.paths = _held.paths, outer
        for path in mine:
            name = spark._jvm.org.apache.hadoop.fs.Path(path)
            name.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(name, True)


def stored(df: DataFrame, label: str, **how: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts the
    lineage, keeps the result if executors are lost, and costs less disk than
    a row-wise checkpoint. ``how``: the writer's options."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if getattr(_held, "paths", None) is not None:
        _held.paths.append(path)
    df.write.options(**how).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
