"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents. All stages but
the last return the columns of ``documents``, and further ones if there are any.

Defined results: a row with a null or empty text, or one without letters, is
rejected by the first stage. A row with a null doc_id passes like others and is
linked with no other row. Of equal rows one stays; rows with one doc_id and
different texts are documents of their own. Ties are settled as each operator's
module says. An empty table gives no pieces. Very long texts are worked on whole.
Further columns, whatever their names, are carried along up to packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodeline.llm import language_id, minhash, packing, quality_rules, suffix_dedup
from lodeline.llm.common import documents, shared_dir
from lodeline.llm.tokens import BYTE_BPE, vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with the language found."""
    return language_id.accepted(docs)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality_rules.cleaned(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur anywhere else."""
    return suffix_dedup.deduplicated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training sequences."""
    return packing.packed(docs, vocabulary_path(BYTE_BPE))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", clean_lines),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model, the shingle hashing or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
