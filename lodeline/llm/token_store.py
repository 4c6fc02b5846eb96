"""Token-ID output: documents' ids in ascending doc_id order, coded by Simple-8b.

``write`` range-partitions the documents by doc_id, encodes each partition in
order and writes segments: a row holds the coded words of consecutive documents
with block offsets, doc_ids and document starts. Spark's Parquet writer is the
container, so that tasks commit whole files to any store that Spark reaches and
a lost executor's task is simply run again. ``read`` decodes segments.

Defined results: a null text is empty and has only the end id; rows with equal
doc_id are ordered by their text's hash, null doc_ids come first; an empty table
gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simple8b
from .common import batch_of, documents, row_key, shared_dir, slices, texts_of
from .tokens import WORD_BPE, encoder, vocabulary_path

END_ID = 1
#: Ids after which a segment is closed; a longer document has a segment to itself.
SEGMENT_IDS = 1 << 18

SEGMENT = "part int, segment int, doc_ids array<bigint>, doc_starts array<bigint>, n_ids bigint, words binary, block_starts array<bigint>"
SEGMENT_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("words", pa.binary()), ("block_starts", pa.list_(pa.int64()))]
)


def _segments(path: str, end_id: int, segment_ids: int):
    def run(batches):
        encode, part, number = encoder(path).encode, None, 0
        ids, docs, starts, held = [], [], [], 0

        def close():
            words, blocks = simple8b.encode(np.concatenate(ids))
            row = {"part": [part], "segment": [number], "doc_ids": [docs], "doc_starts": [starts], "n_ids": [held], "words": [words.astype("<u8").tobytes()], "block_starts": [blocks.tolist()]}
            return batch_of(SEGMENT_ARROW, row)

        for batch in slices(batches, "text"):
            for doc, p, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encode(texts_of(batch))):
                if held and held + len(found) + 1 > segment_ids:
                    yield close()
                    ids, docs, starts, held, number = [], [], [], 0, number + 1
                part = p
                ids += [found, np.array([end_id], "<u4")]
                docs.append(doc)
                starts.append(held)
                held += len(found) + 1
        if docs:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes all texts and writes the store to ``path``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), row_key(F.col("text")))
    placed = placed.select("doc_id", "text", F.spark_partition_id().alias("part"))
    placed.mapInArrow(_segments(tokenizer_path, end_id, segment_ids), SEGMENT).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The store's segments with ``base``: the ids in all segments before each.
    Only one small row for each file part meets in one task."""
    stored = spark.read.schema(SEGMENT).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_base"))
    light = stored.select("part", "segment", "n_ids")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    bases = light.withColumn("inside", inside).join(before, "part").select("part", "segment", (F.col("inside") + F.col("part_base")).alias("base"))
    return stored.join(bases, ["part", "segment"])


DOCUMENT_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.array(row["block_starts"])).astype("<u4")
            starts = np.array(row["doc_starts"] + [row["n_ids"]])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
            yield batch_of(DOCUMENT_ARROW, {"doc_id": row["doc_ids"], "start": row["base"] + starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": crc})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the store."""
    return segments(spark, path).select("doc_ids", "doc_starts", "n_ids", "words", "block_starts", "base").mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path, vocabulary_path(WORD_BPE))
    return read_documents(spark, path)
