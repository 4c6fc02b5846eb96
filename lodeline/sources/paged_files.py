"""A data source of files that need a reader: word-processor and paged files.

``spark.read.format("document_files").load(folder)`` and the same of ``readStream``
give (path, kind, byte_size, marked, error) of all readable files below a folder: the
text of plain and marked-up files, a word-processor file as HTML, a paged one with a
line after each page. Files are opened in tasks, about ``GROUP_BYTES`` of them in each;
one that cannot be read has its error in its row. Listing and opening go through Arrow's
file systems, so a folder may be local or in any store these know.

A stream's offset is the last file's time and path; what is younger than ``SETTLED``
seconds waits for the next batch, so that a file written at the same moment is not
passed over.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text as T
from . import files

NAME = "document_files"
SCHEMA = "path string, kind string, byte_size bigint, marked string, error string"
_ROWS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("byte_size", pa.int64()), ("marked", pa.string()), ("error", pa.string())])
GROUP_BYTES, SETTLED = 64 << 20, 1.0
KINDS = {e: k for k, es in (("plain", files.PLAIN), ("html", files.HTML), ("pdf", files.PDF), ("docx", files.DOCX)) for e in es}


class Group(InputPartition):
    """Some files of one task: (path, size)."""

    def __init__(self, found: list[tuple[str, int]]):
        self.files = found


def listed(folder: str) -> tuple[stores.FileSystem, list[stores.FileInfo]]:
    store, path = stores.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (stores.LocalFileSystem(), folder)
    found = store.get_file_info(stores.FileSelector(path, recursive=True))
    return store, [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]


def grouped(found: list[stores.FileInfo]) -> list[Group]:
    out, held, size = [], [], 0
    for f in sorted(found, key=lambda f: f.path):
        if held and size + f.size > GROUP_BYTES:
            out.append(Group(held))
            held, size = [], 0
        held.append((f.path, f.size))
        size += f.size
    return [*out, Group(held)] if held else out


def read(folder: str, group: Group) -> Iterator[pa.RecordBatch]:
    store = stores.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else stores.LocalFileSystem()
    for path, size in group.files:
        kind, marked, error = KINDS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "unsupported"), None, None
        try:
            if size > files.MAX_BYTES:
                raise ValueError(f"Files of over {files.MAX_BYTES >> 20} MB are not read.")
            if kind != "unsupported":
                with store.open_input_stream(path) as f:
                    content = f.read()
                marked = files.docx_html(content) if kind == "docx" else files.pdf_text(content) if kind == "pdf" else content.decode("utf-8", "replace")
        except Exception as e:  # a broken file fails alone
            error = f"{type(e).__name__}: {e}"[:500]
        yield pa.RecordBatch.from_pylist([{"path": path, "kind": kind, "byte_size": size, "marked": marked, "error": error}], schema=_ROWS)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Group]:
        return grouped(listed(self.folder)[1]) or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return read(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        ready = [f for f in listed(self.folder)[1] if f.mtime_ns <= (time.time() - SETTLED) * 1e9]
        at, path = max(((f.mtime_ns, f.path) for f in ready), default=(0, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        after, until = (start["at"], start["path"]), (end["at"], end["path"])
        return grouped([f for f in listed(self.folder)[1] if after < (f.mtime_ns, f.path) <= until])

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return read(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def load(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The source's rows, as a table or a stream."""
    spark.dataSource.register(DocumentFiles)
    return (spark.readStream if stream else spark.read).format(NAME).load(folder)


def texts(rows: DataFrame) -> DataFrame:
    """path, text, pages, page_count, byte_size, error of the source's rows, as
    ``files.extracted`` gives them of contents."""
    none = [F.lit(None).cast(files.PAGES).alias("pages"), F.lit(None).cast("int").alias("page_count")]
    error = F.coalesce("error", files.refusal(F.col("path"))).alias("error")
    text = F.when(F.col("kind") == "plain", T.clean(F.col("marked"))).when(F.col("marked").isNotNull(), T.html_text(F.col("marked")))
    direct = rows.filter("kind <> 'pdf'").select("path", text.alias("text"), *none, "byte_size", error)
    pdf = rows.filter("kind = 'pdf'")
    return direct.unionByName(pdf.join(files.paged(pdf.filter("error IS NULL").select("path", "marked"), "path"), "path", "left").select("path", "text", "pages", "page_count", "byte_size", "error"))
