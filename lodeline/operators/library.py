"""A library of documents: tables partitioned by document bucket, and what
happens to them.

Adding appends rows to the buckets of its documents. What changes rows that are
there (a state, new passages, a deletion) rewrites the buckets it touches by Spark's
dynamic partition overwrite, so nothing is left to be compacted. A document's row
carries the version it is in. Work that takes long starts from that version and is
put in place at the end: writers take turns for this last step, look at the documents
as they are by then, and leave out those that were changed or deleted meanwhile. So a
deletion holds whatever runs beside it, and two writers lose nothing of each other's.
A document is ready only once its passages are in place.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as sources
from . import chunking, citations, index, retrieval
from .embedding import Embedder, HashEmbedder
from .staging import passing, stored

WORKING = ("pending", "extracting", "chunking", "embedding")
NO_TEXT = "The file was read, but there is no text in it; a scan needs text recognition."
NO_CHUNKS = "No passages could be made of the text."
LOST = "The work on this document was broken off before its text was kept. Please add the file anew."
NO_HITS = "No passage in the library has to do with this question. Other words may help, or a document that deals with it has to be added."
NO_REPLY = "The model's reply could not be read, not even when asked again."
#: Of the tables' layout; parts that a new library's documents are dealt to; seconds that a writer waits for its turn.
VERSION, BUCKETS, PATIENCE = 4, 64, 600
DOCUMENT = (
    "id bigint, title string, source_type string, filename string, mime string, byte_size bigint, content_hash string, char_count bigint, page_count int, "
    "collection string, status string, error string, added_at timestamp, indexed_at timestamp"
)
TEXT = "extracted_text string, pages array<struct<page:int,start:bigint,end:bigint>>"
PASSAGE = "id bigint, document_id bigint, ordinal int, text string, heading string, page int, char_start bigint, char_end bigint, token_est bigint, embedding array<float>"
ASKED = "id bigint, question string, answer string, citations string, stats string, asked_at timestamp"
TABLES = {
    "documents": f"{DOCUMENT}, version string, bucket int", "texts": f"id bigint, {TEXT}, bucket int", "passages": f"{PASSAGE}, bucket int", "postings": f"{index.INDEX}, bucket int",
    "queries": ASKED, "config": "provider string, model string, dims int, layout int, buckets int, at bigint", "progress": "document_id bigint, stage string, percent int, at bigint",
}
#: Tables that are partitioned, and what names a document in them; postings are made anew from their bucket's passages.
KEYS = {"documents": "id", "texts": "id", "passages": "document_id"}


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def document_id(hashed: Column) -> Column:
    """A document's name from its content's hash, 60 bits of it: no counter that
    all writers would have to share."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def new_documents(added: DataFrame, known: DataFrame) -> DataFrame:
    """Of added rows (content_hash, ...), the first of each hash that no document
    has, failed ones aside (they may be added again)."""
    return added.dropDuplicates(["content_hash"]).join(known.filter("status <> 'failed'").select("content_hash"), "content_hash", "left_anti")


#: Rounds that vectors are made in at most, and passages of a round at least.
EMBED_STEPS, EMBED_LEAST = 8, 5000


def percent(done: Column, total: Column) -> Column:
    """How far a document is while its passages are embedded."""
    return (25 + F.floor(done / total * 65 + 0.5)).cast("long")


def ingest_status(text: Column) -> Column:
    """What becomes of an extracted text: its error, or null."""
    return F.when(F.length(T.trimmed(F.coalesce(text, F.lit("")))) < 20, NO_TEXT)


def recovery(documents: DataFrame) -> DataFrame:
    """What to do with documents that an interruption left: rebuild, or fail."""
    stuck = documents.filter(F.col("status").isin(*WORKING))
    has = F.col("extracted_text").isNotNull()
    return stuck.select("id", "title", has.alias("has_text"), F.when(has, "pending").otherwise("failed").alias("new_status"), F.when(~has, LOST).alias("error"))


def stats(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: documents, passages and vectors, and documents by status."""
    by = documents.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    whole = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    return whole.join(passages.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("vectors")))


def with_counts(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents, latest first, with their number of passages."""
    n = passages.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    return documents.join(n, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).orderBy(F.desc("added_at"), F.desc("id"))


def reason(error: Exception) -> str:
    """What went wrong, without the trace that a task's error comes with."""
    lines = str(error).split("\n")
    named = [x.strip() for x in lines if re.match(r"\s*\w*(Error|Exception): ", x)]
    return (named[0] if named else lines[0])[:500]


class Library:
    """Documents, their texts, passages with vectors, postings, asked questions and
    progress, under one folder. ``buckets``: of a new library; a change of
    documents that are there rewrites theirs, so there are to be as many as keep a
    bucket's rewriting cheap."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.embedder, self.buckets = spark, path.rstrip("/"), embedder or HashEmbedder(), buckets
        #: Why the last search had to do without vectors, or None.
        self.vector_error: str | None = None
        if self._exists("commits"):
            self._migrate()
        for name in TABLES:
            if not self._exists(name):
                spark.createDataFrame([], TABLES[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        newest = self._all("config").agg(F.max("layout").alias("layout"), F.max("buckets").alias("buckets")).first()
        if newest.layout and newest.layout > VERSION:
            raise ValueError(f"The library's tables have layout {newest.layout}; this program knows {VERSION} and older ones.")
        if newest.buckets:
            self.buckets = newest.buckets
        else:
            self._configure(None)

    # -- storage ----------------------------------------------------------------

    def _bucket(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def _place(self, name: str) -> tuple:
        """A file or folder of the library's, and the file system it is in."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _exists(self, name: str) -> bool:
        fs, place = self._place(name)
        return fs.exists(place)

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _columns(self, name: str) -> list[str]:
        return [c.strip().split()[0] for c in re.split(r",(?![^<]*>)", TABLES[name])]

    def _write(self, name: str, rows: DataFrame, mode: str = "append") -> None:
        """Appends rows, or puts them in place of all in their buckets. Rows are
        dealt by bucket first, so that a small change writes few files; Spark
        splits what is more than a task's share."""
        columns = self._columns(name)
        writer = rows.select(*columns)
        if "bucket" in columns:
            writer = writer if name == "postings" else writer.hint("rebalance", "bucket")
            writer = writer.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic")
        else:
            writer = writer.coalesce(1).write
        if name == "postings":
            writer = writer.options(**index.WRITING)
        writer.mode(mode).parquet(f"{self.path}/{name}")

    @contextmanager
    def _turn(self) -> Iterator[None]:
        """Writers put their changes in place one after another: a folder's file
        can be created once. One that a broken writer left has to be removed by
        ``unlock``."""
        fs, place = self._place("_turn")
        until = time.monotonic() + PATIENCE
        while not fs.createNewFile(place):
            if time.monotonic() > until:
                raise TimeoutError("Another writer has not ended its turn; if none is at work, call unlock().")
            time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(place, False)

    def unlock(self) -> None:
        """Ends the turn of a writer that broke off."""
        fs, place = self._place("_turn")
        fs.delete(place, False)

    def _touched(self, ids: DataFrame) -> list[int]:
        """The buckets of some documents, as many as there are at most."""
        return [r.bucket for r in ids.select(self._bucket(F.col("id")).alias("bucket")).distinct().collect()]

    def _replace(self, name: str, ids: DataFrame, rows: DataFrame | None) -> None:
        """Puts ``rows`` in place of what some documents (id) have in a table."""
        buckets = self._touched(ids)
        here = self._all(name).filter(F.col("bucket").isin(buckets))
        key = KEYS[name]
        old = here.join(ids.select(F.col("id").alias(key)), key, "left_semi")
        if name != "documents" and old.isEmpty():
            if rows is not None:
                self._write(name, rows)
            return
        rest = here.join(ids.select(F.col("id").alias(key)), key, "left_anti").select(*self._columns(name))
        whole = stored(rest if rows is None else rest.unionByName(rows.select(*self._columns(name))), name)
        self._write(name, whole, "overwrite")
        self._clear(name, set(buckets) - {r.bucket for r in whole.select("bucket").distinct().collect()})

    def _clear(self, name: str, buckets: set[int]) -> None:
        """An overwrite leaves buckets alone for which it has no rows."""
        for b in buckets:
            fs, place = self._place(f"{name}/bucket={b}")
            fs.delete(place, True)

    def _post(self, passages: DataFrame, buckets: list[int] | None = None) -> None:
        """Appends the postings of passages (id, text, heading, bucket), segments
        of one bucket each; with ``buckets``, in place of those there."""
        rows = passages.select(F.col("id").alias("chunk_id"), "text", "heading", "bucket").hint("rebalance", "bucket").sortWithinPartitions("bucket")
        made = stored(rows.mapInArrow(index.by_bucket, f"{index.INDEX}, bucket int"), "postings", **index.WRITING)
        self._write("postings", made, "append" if buckets is None else "overwrite")
        if buckets is not None:
            self._clear("postings", set(buckets) - {r.bucket for r in made.select("bucket").distinct().collect()})

    @property
    def documents(self) -> DataFrame:
        return self._all("documents").join(self._all("texts"), ["id", "bucket"], "left").drop("bucket", "version")

    @property
    def passages(self) -> DataFrame:
        return self._all("passages").drop("bucket")

    @property
    def queries(self) -> DataFrame:
        return self._all("queries")

    @property
    def progress(self) -> DataFrame:
        """The last stage of each document: document_id, stage, percent, at."""
        last = F.max_by(F.struct("stage", "percent", "at"), F.struct("at", "percent"))
        return self._all("progress").groupBy("document_id").agg(last.alias("e")).select("document_id", "e.*")

    def _tell(self, ids: DataFrame, stage: Column | str, percent: Column | int | None) -> None:
        stage = F.lit(stage) if isinstance(stage, str) else stage
        percent = percent if isinstance(percent, Column) else F.lit(percent)
        self._write("progress", ids.select(F.col("id").alias("document_id"), stage.alias("stage"), percent.cast("int").alias("percent"), F.lit(time.time_ns()).alias("at")))

    def config(self) -> dict | None:
        """The model of the index, or None before the first and after a clearing."""
        last = self._all("config").orderBy(F.desc("at")).limit(1).collect()
        return last[0].asDict() if last and last[0].model else None

    def _configure(self, model: Embedder | None) -> None:
        named = (model.provider, model.model, model.dims) if model else (None, None, None)
        self._write("config", self.spark.createDataFrame([(*named, VERSION, self.buckets, time.time_ns())], TABLES["config"]))

    def check_config(self) -> None:
        """Vectors of two models cannot be compared: refused on writing and on asking."""
        was, now = self.config(), self.embedder
        if was and (was["model"], was["dims"]) != (now.model, now.dims):
            raise ValueError(f"The passages have vectors of {was['model']} with {was['dims']} numbers; {now.model} with {now.dims} does not go with them. Use that model, or index the library anew.")

    def _migrate(self) -> None:
        """Tables of layout 3, where rows carried batches and commits made them
        seen: the last committed version of each document is taken over. The
        old tables are put aside and go at the end, so this can be repeated."""
        def moved(name: str, to: str | None) -> None:
            fs, place = self._place(name)
            if to is None:
                fs.delete(place, True)
            elif not self._exists(to):
                fs.rename(place, self._place(to)[1])

        for name in ("documents", "passages", "terms"):
            moved(name, f"layout3-{name}")
        for name in ("documents", "texts", "passages", "postings", "config"):
            moved(name, None)
        old = lambda name: self.spark.read.parquet(f"{self.path}/{name}")
        light = old("layout3-documents").select("id", "batch", "gone").join(old("commits").select("batch", "at"), "batch")
        last = light.groupBy("id").agg(F.max_by(F.struct("batch", "gone"), F.struct("at", "batch")).alias("v")).filter("NOT v.gone").select("id", "v.batch")
        documents = old("layout3-documents").join(last, ["id", "batch"], "left_semi").withColumn("version", F.col("batch")).withColumn("bucket", self._bucket(F.col("id")))
        passages = old("layout3-passages").join(last.withColumnRenamed("id", "document_id"), ["document_id", "batch"], "left_semi").withColumn("bucket", self._bucket(F.col("document_id")))
        self._write("documents", documents)
        self._write("texts", documents)
        self._write("passages", passages)
        self._post(self._all("passages"))
        for r in old("commits").filter("model IS NOT NULL OR change = 'clear'").orderBy(F.desc("at")).limit(1).collect():
            self._write("config", self.spark.createDataFrame([(r.provider, r.model, r.dims, VERSION, self.buckets, time.time_ns())], TABLES["config"]))
        for name in ("layout3-documents", "layout3-passages", "layout3-terms", "commits"):
            moved(name, None)

    # -- documents --------------------------------------------------------------

    def _settle(self, rows: DataFrame, passages: DataFrame | None) -> DataFrame:
        """Puts documents (with the ``version`` they were made from) and their
        passages in place, except those that are not as they were; returns which."""
        with self._turn():
            now = self._all("documents").filter(F.col("bucket").isin(self._touched(rows))).select("id", "version")
            still = stored(rows.join(now, ["id", "version"], "left_semi").withColumn("version", F.lit(uuid.uuid4().hex)).withColumn("bucket", self._bucket(F.col("id"))), "settled")
            ids = still.select("id")
            if passages is not None:
                mine = passages.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi").withColumn("bucket", self._bucket(F.col("document_id")))
                buckets = self._touched(ids)
                first = self._all("passages").filter(F.col("bucket").isin(buckets)).join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi").isEmpty()
                self._replace("passages", ids, mine)
                if first:
                    self._post(mine)
                else:
                    self._post(self._all("passages").filter(F.col("bucket").isin(buckets)), buckets)
            self._replace("documents", ids, still)
        return still

    def _indexed(self, documents: DataFrame) -> None:
        """Builds passages and vectors of documents (stored, with text and
        version), and puts them in place."""
        told = documents.withColumn("error", F.coalesce("error", ingest_status(F.col("extracted_text"))))
        good = told.filter("error IS NULL").select(F.col("id").alias("document_id"), F.col("extracted_text").alias("text"), "pages", "title")
        ids = good.select(F.col("document_id").alias("id"))
        self._tell(ids, "chunking", 15)
        cut = stored(chunking.chunked(good.select("document_id", "text", "pages")), "passages")
        passages = self._embedded(cut, good)
        n = cut.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
        out = told.join(n, "id", "left").withColumn("error", F.coalesce("error", F.when(F.col("_n").isNull(), NO_CHUNKS)))
        warning = T.extraction_warning(F.col("extracted_text"), F.col("page_count"))
        out = out.withColumn("status", F.when(F.col("error").isNull(), "ready").otherwise("failed"))
        out = out.withColumn("indexed_at", F.when(F.col("status") == "ready", F.current_timestamp())).withColumn("char_count", F.length("extracted_text").cast("long"))
        out = stored(out.withColumn("error", F.substring(F.coalesce("error", warning), 1, 500)).drop("_n", "extracted_text", "pages"), "indexed")
        settled = self._settle(out, passages)
        self._configure(self.embedder)
        self._tell(settled, F.col("status"), F.when(F.col("status") == "ready", 100))

    def _embedded(self, cut: DataFrame, documents: DataFrame) -> DataFrame:
        """Passages with their vectors, made in rounds of whole passages; after
        each, every document's share is told."""
        rounds = max(1, min(EMBED_STEPS, cut.count() // EMBED_LEAST))
        named = cut.join(documents.select("document_id", "title"), "document_id").select("id", "document_id", T.embeddable(F.col("title"), F.col("heading"), F.col("text")).alias("_embed"))
        named = named.withColumn("_round", F.pmod(F.xxhash64("id"), F.lit(rounds)))
        self._tell(documents.select(F.col("document_id").alias("id")), "embedding", 25)
        parts = []
        for i in range(rounds):
            parts.append(stored(self.embedder.vectors(named.filter(F.col("_round") == i).select("id", "_embed"), "id", "_embed"), "vectors"))
            share = named.groupBy(F.col("document_id").alias("id")).agg(F.count_if(F.col("_round") <= i).alias("done"), F.count(F.lit(1)).alias("total"))
            self._tell(share, "embedding", percent(F.col("done"), F.col("total")))
        vectors = parts[0]
        for more in parts[1:]:
            vectors = vectors.unionByName(more)
        return stored(cut.join(vectors, "id"), "embedded")

    def add(self, files: DataFrame, collection: str = "", source_type: str = "file") -> DataFrame:
        """Adds files (path, content); returns path, document_id and duplicate of
        each. A document waits as pending, with its text, until its passages
        and vectors are in place. Of files with equal contents the first by path
        is kept; files with equal paths and other contents are documents of their own."""
        self.check_config()
        # All files' names and hashes, and only fresh files' contents, are kept: files are read twice.
        rows = stored(files.select("path", content_hash(F.col("content")).alias("content_hash")), "hashes")
        known = stored(self._all("documents").select("id", "content_hash", "status"), "known")
        wanted = new_documents(rows.groupBy("content_hash").agg(F.min("path").alias("path")), known)
        names = wanted.select(document_id(F.col("content_hash")).alias("id"), "content_hash").union(known.select("id", "content_hash"))
        if not names.groupBy("id").agg(F.countDistinct("content_hash").alias("n")).filter("n > 1").isEmpty():
            raise ValueError("Two different documents have hashes that begin alike; the second cannot be added.")
        fresh = files.select("path", "content", content_hash(F.col("content")).alias("content_hash")).join(wanted, ["content_hash", "path"], "left_semi")
        fresh = stored(fresh.dropDuplicates(["content_hash"]), "fresh")
        if not fresh.isEmpty():
            with passing(self.spark):
                made = self._received(sources.extracted(fresh, "content_hash"), collection, source_type)
                self._tell(made, "extracting", 5)
                self._indexed(made)
        ids = self._all("documents").select("content_hash", F.col("id").alias("document_id"), "status", "error")
        old = known.filter("status <> 'failed'").select("content_hash").withColumn("duplicate", F.lit(True))
        return rows.join(ids, "content_hash").join(old, "content_hash", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))

    def _received(self, texts: DataFrame, collection: str, source_type: str) -> DataFrame:
        """Extracted texts as pending documents, unless another writer was faster."""
        name = F.regexp_extract("path", r"([^/\\]*)\z", 1)
        made = texts.select(
            document_id(F.col("content_hash")).alias("id"),
            F.substring(F.coalesce(F.nullif(sources.title_of(name), F.lit("")), F.lit("Untitled")), 1, 300).alias("title"), F.lit(source_type).alias("source_type"), name.alias("filename"), F.lit(None).cast("string").alias("mime"),
            "byte_size", "content_hash", F.length("text").cast("long").alias("char_count"), "page_count", F.lit(collection[:80]).alias("collection"), F.lit("pending").alias("status"),
            "error", F.current_timestamp().alias("added_at"), F.lit(None).cast("timestamp").alias("indexed_at"), F.col("text").alias("extracted_text"), "pages", F.lit(uuid.uuid4().hex).alias("version"),
        )
        made = stored(made.withColumn("bucket", self._bucket(F.col("id"))), "received")
        with self._turn():
            now = self._all("documents").filter(F.col("bucket").isin(self._touched(made)))
            made = stored(new_documents(made, now), "added")
            self._tell(made, "queued", 0)
            self._replace("texts", made.select("id"), made)
            self._replace("documents", made.select("id"), made)
        return made

    def upload(self, files: DataFrame, collection: str = "") -> DataFrame:
        """Adds the files of one upload, whose number is limited."""
        return self.add(sources.checked_upload(files), collection, "upload")

    def delete(self, ids: list[int] | DataFrame) -> None:
        """Documents with their texts, passages and postings; a table of ids has
        them in ``id``. A document's row goes last, so that a deletion that
        breaks off can be repeated."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        with passing(self.spark), self._turn():
            ids = stored(self._all("documents").join(ids.select("id"), "id", "left_semi").select("id"), "deleted")
            buckets = self._touched(ids)
            if not buckets:
                return
            self._replace("passages", ids, None)
            self._post(self._all("passages").filter(F.col("bucket").isin(buckets)), buckets)
            self._replace("texts", ids, None)
            self._replace("documents", ids, None)

    def reindex(self, documents: DataFrame | None = None) -> None:
        """Builds passages and vectors anew from kept texts, with the present
        model; documents (id) without text fail."""
        here = self._all("documents")
        here = here if documents is None else here.join(documents.select("id"), "id", "left_semi")
        whole = here.join(self._all("texts"), ["id", "bucket"], "left").drop("bucket")
        lost = F.when(F.col("extracted_text").isNull() & F.col("error").isNull(), LOST).when(F.col("extracted_text").isNull(), F.col("error"))
        with passing(self.spark):
            self._indexed(stored(whole.withColumn("error", lost), "reindex"))

    def recover(self) -> DataFrame:
        """Finishes what an interruption left; returns what was stuck."""
        stuck = stored(recovery(self.documents), "stuck")
        if not stuck.isEmpty():
            self.reindex(stuck)
        return stuck

    def clear_index(self) -> None:
        """No passages, no model; documents wait."""
        with passing(self.spark), self._turn():
            waiting = self._all("documents").withColumn("status", F.lit("pending")).withColumn("indexed_at", F.lit(None).cast("timestamp")).withColumn("version", F.lit(uuid.uuid4().hex))
            waiting = stored(waiting, "waiting")
            for name in ("passages", "postings"):
                self._clear(name, set(range(self.buckets)))
            self._write("documents", waiting, "overwrite")
            self._configure(None)

    def stats(self) -> DataFrame:
        return stats(self._all("documents"), self.passages)

    def doctor(self) -> dict:
        """Whether the tables can be read and the embedder gives its width."""
        one = self.spark.createDataFrame([(1, "test")], "id bigint, text string")
        width = len(self.embedder.vectors(one, "id", "text", "query").first()["embedding"])
        return {"width": width, "expected": self.embedder.dims, "documents": self._all("documents").count(), "passages": self.passages.count()}

    # -- asking -----------------------------------------------------------------

    def search(self, questions: DataFrame, limit: int = retrieval.LIMIT, mode: str = "hybrid", **how) -> DataFrame:
        """Best passages of questions (question_id, question), each with a marked
        excerpt. If the questions cannot be embedded, keywords alone decide and
        ``vector_error`` tells why."""
        self.check_config()
        mode = mode if mode in ("hybrid", "vector", "keyword") else "hybrid"
        asked, self.vector_error = None, None
        if mode != "keyword":
            try:
                asked = stored(self.embedder.vectors(questions, "question_id", "question", "query"), "asked")
            except Exception as e:  # whatever a model's task raises
                mode, self.vector_error = "keyword", reason(e)
        passages = self.passages
        postings = self._all("postings").drop("bucket")
        vectors = passages.select(F.col("id").alias("chunk_id"), "embedding")
        hits = retrieval.search(passages.drop("embedding", "token_est"), self._all("documents"), questions, mode, min(limit or 10, 30), index=postings, vectors=vectors, asked=asked, **how)
        return hits.join(questions.select("question_id", "question"), "question_id").withColumn("excerpt", T.highlighted(F.col("text"), F.col("question"))).drop("question")

    def around(self, chunks: DataFrame, span: int = 1) -> DataFrame:
        """The passages around others (chunk_id) in their documents."""
        return retrieval.neighbours(self.passages, chunks, span)

    def ask(self, questions: DataFrame, model: Callable[[str, str], str], limit: int = 8, language: str | None = None, tries: int = 2, wait: float = 2.0) -> DataFrame:
        """Answers questions from the library by a model (instructions, request)
        -> reply. A reply that is no JSON is asked for once more; if that fails
        too, or the model raises ``tries`` times, the question's ``error`` says
        so. What the model said is stored before it is checked, so it is asked
        once. Citations are verified and the result is added to ``queries``."""
        hits = stored(self.search(questions.filter(T.trimmed(F.col("question")) != ""), min(limit or 8, 20)), "hits")
        packed = citations.packed_sources(hits)
        asked = questions.join(citations.context(packed), "question_id").select("question_id", "question", "context")

        def called(text: str) -> str:
            for turn in range(1, tries + 1):
                try:
                    return model(citations.INSTRUCTIONS, text)
                except Exception:
                    if turn == tries:
                        raise
                    time.sleep(wait)

        def reply(batches):
            for batch in batches:
                out, errors = [], []
                for q, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    text = error = None
                    try:
                        text = called(citations.request(q, c, language))
                        if not citations.reply_is_json(text):
                            text = called(citations.request(q, c, language, again=True))
                        if not citations.reply_is_json(text):
                            error = NO_REPLY
                    except Exception as e:  # a question that fails fails alone
                        error = f"{type(e).__name__}: {e}"[:500]
                    out.append(text)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["question_id", "reply", "error"])

        replies = stored(asked.mapInArrow(reply, "question_id bigint, reply string, error string"), "replies")
        parsed = replies.filter("error IS NULL").select("question_id", citations.parsed_reply(F.col("reply")).alias("r")).select("question_id", "r.*")
        labelled = packed.select("question_id", "label", "text", "chunk_id", "document_id", "document_title", "heading", "page", "ordinal")
        out = citations.verified(parsed, labelled).withColumn("error", F.lit(None).cast("string"))
        rest = questions.join(replies.select("question_id", "error"), "question_id", "left").join(parsed.select("question_id"), "question_id", "left_anti")
        empty = {f.name: F.lit(None).cast(f.dataType) for f in out.schema.fields} | {"question_id": F.col("question_id"), "error": F.col("error")}
        empty |= {"answer": F.when(F.col("error").isNull(), NO_HITS), "confidence": F.lit("none"), "missing": F.lit("")} | {c: F.lit(0).cast(out.schema[c].dataType) for c in ("checked", "kept", "dropped")}
        result = stored(out.unionByName(rest.select(*[empty[c].alias(c) for c in out.columns])), "answers")
        log = result.join(questions, "question_id").select(
            F.col("question_id").alias("id"), "question", "answer", F.to_json("citations_kept").alias("citations"),
            F.to_json(F.struct("checked", "kept", "dropped", "confidence", "error")).alias("stats"), F.current_timestamp().alias("asked_at"),
        )
        self._write("queries", log)
        return result
