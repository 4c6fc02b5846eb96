"""Exact token counts of whole texts, huge documents included.

Texts of up to ``chunk_chars`` are encoded as they are. Longer ones are cut into
overlapping chunks that are spread over the tasks and encoded with offsets. Two
neighbouring chunks are spliced at a position of their overlap at which both
start a pre-token: the pre-tokenizer looks only ahead, so from a true boundary
on both read the same, and the left chunk's boundaries are true up to a margin
before its end that covers any look-ahead and any special token's string. A
document with an overlap without such a position is cut anew with chunks and
overlaps eight times as wide, at last whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; equal rows are
counted once and returned as often as they occur; an empty table gives none.
Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, documents, row_key, slices, stored, texts_of
from .tokens import BYTE_BPE, encoder, library, vocabulary_path

CHUNK_CHARS, OVERLAP_CHARS, WIDEN, LIMIT = 32_768, 512, 8, 512
#: Characters before a chunk's end in which its boundaries are not trusted.
MARGIN = 32

_COUNT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_CUT = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("chunk", pa.int64()), ("lo", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
_ENDS = pa.schema(
    [("doc_id", pa.int64()), ("rk", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("n", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("left_at", "left_n", "right_at", "right_n")]
)
ENDS = "doc_id bigint, rk bigint, chunk bigint, last boolean, n bigint, left_at array<bigint>, left_n array<bigint>, right_at array<bigint>, right_n array<bigint>"


def _whole(path: str):
    def run(batches):
        encode = encoder(path).encode
        for batch in slices(batches, "text"):
            yield batch_of(_COUNT, {"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": [len(x) for x in encode(texts_of(batch))]})

    return run


def _cut(chunk_chars: int, overlap: int):
    def run(batches):
        for batch in slices(batches, "text"):
            for doc, rk, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lo, number = 0, 0
                while True:
                    last = lo + chunk_chars >= len(text)
                    yield batch_of(_CUT, {"doc_id": [doc], "rk": [rk], "chunk": [number], "lo": [lo], "last": [last], "text": [text[lo : lo + chunk_chars]]})
                    if last:
                        break
                    lo, number = lo + chunk_chars - overlap, number + 1

    return run


def chunk_ends(text: str, lo: int, overlap: int, path: str, last: bool = False) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Token count, and the pre-token starts in the left and right overlap,
    as places in the document with the tokens before them in the chunk."""
    found = library(path).encode(text, add_special_tokens=False)
    words, offsets = found.word_ids, found.offsets
    starts = [(offsets[i][0], i) for i in range(len(words)) if i == 0 or words[i] != words[i - 1]]
    left = [(p, i) for p, i in starts if p < overlap]
    right = [] if last else [(p, i) for p, i in starts if len(text) - overlap <= p <= len(text) - MARGIN]
    return len(words), [lo + p for p, _ in left], [i for _, i in left], [lo + p for p, _ in right], [i for _, i in right]


def _ends(path: str, overlap: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, *lists = chunk_ends(row["text"], row["lo"], overlap, path, row["last"])
                yield batch_of(_ENDS, {"doc_id": [row["doc_id"]], "rk": [row["rk"]], "chunk": [row["chunk"]], "last": [row["last"]], "n": [n]} | {c: [v] for c, v in zip(("left_at", "left_n", "right_at", "right_n"), lists)})

    return run


def spliced(ends: DataFrame) -> DataFrame:
    """doc_id, rk, n_tokens of each cut document; null where an overlap has no
    common boundary."""
    order = Window.partitionBy("doc_id", "rk").orderBy("chunk")
    nxt = ends.select("*", F.lead("left_at").over(order).alias("next_at"), F.lead("left_n").over(order).alias("next_n"))
    at = F.element_at(F.array_intersect("right_at", "next_at"), 1)  # of pre-token starts in both
    seam = nxt.select("doc_id", "rk", "last", "n", "right_at", "right_n", "next_at", "next_n", F.when(~F.col("last") & (F.size(F.array_intersect("right_at", "next_at")) > 0), at).alias("at"))
    before = F.element_at("right_n", F.array_position("right_at", F.col("at")).cast("int"))
    skipped = F.element_at("next_n", F.array_position("next_at", F.col("at")).cast("int"))
    part = F.when(F.col("last"), F.col("n")).when(F.col("at").isNotNull(), before - skipped)
    return seam.groupBy("doc_id", "rk").agg(F.when(F.count(part) == F.count(F.lit(1)), F.sum(part)).alias("n_tokens"))


def counted(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row."""
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = rows.filter(~is_long).mapInArrow(_whole(tokenizer_path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    huge = rows.filter(is_long).withColumn("rk", row_key(F.col("text")))
    sizes = huge.groupBy("doc_id", "rk", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
    longest = stored(huge.agg(F.max(F.length("text")).alias("longest")), "token-longest").first()["longest"] or 0
    left, done = huge.dropDuplicates(["doc_id", "rk"]), []
    while longest:
        cut = left.select("doc_id", "rk", "text").mapInArrow(_cut(chunk_chars, overlap), "doc_id bigint, rk bigint, chunk bigint, lo bigint, last boolean, text string")
        parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = cut.repartition(parts, "rk", "chunk").mapInArrow(_ends(tokenizer_path, overlap), ENDS)
        result = stored(spliced(found), "token-counts")
        done.append(result.filter("n_tokens IS NOT NULL"))
        failed = result.filter("n_tokens IS NULL").select("doc_id", "rk")
        if chunk_chars >= longest or failed.isEmpty():
            break
        chunk_chars, overlap = chunk_chars * WIDEN, overlap * WIDEN
        same = huge["doc_id"].eqNullSafe(failed["doc_id"]) & (huge["rk"] == failed["rk"])
        left = huge.join(failed, same, "left_semi").dropDuplicates(["doc_id", "rk"])
    out = short
    for part in done:
        same = part["doc_id"].eqNullSafe(sizes["doc_id"]) & (part["rk"] == sizes["rk"])
        back = sizes.join(part, same).select(sizes["doc_id"], "n_bytes", "n_tokens", F.explode(F.expr("array_repeat(1, int(copies))")).alias("_copy")).drop("_copy")
        out = out.unionByName(back)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir), vocabulary_path(BYTE_BPE))
