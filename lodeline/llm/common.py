"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_dir, stored  # noqa: F401  what several operators use

#: What separates words: the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
NO_GAP = r"[^\x20\x09-\x0D]+"
#: Texts are handed to numpy in slices of about so many bytes.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(text: Column, *others: Column) -> Column:
    """64 bits that name a row by its content, so that rows with a null or a
    repeated doc_id stay apart unless they are equal."""
    return F.xxhash64(text, *others)


def long_row_key(text: Column, *others: Column) -> Column:
    """The same in 128 bits, for tables of very many rows."""
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(half(F.xxhash64(text, *others)), half(F.xxhash64(F.lit(1), *others, text))))


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of a slice hold about ``size``
    bytes; a longer text comes alone."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
            if i > start and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=schema.field(k).type) for k, v in columns.items()], schema=schema
    )
