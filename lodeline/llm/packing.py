"""Packing documents into training sequences, first fit decreasing.

Documents are dealt to groups by a hash, so groups are random, of bounded mean
size, and packed independently. In a group, whole sequences are first cut from
documents longer than one; what is left of each document is then placed by first
fit decreasing, the first open sequence with enough room being found by
descending a tournament tree whose nodes hold the largest room below them. The
sequences that stay underfilled are opened again: from the emptiest on, their
pieces are cut to fill the room of the others, so that one sequence of a group
is left over. That one is split at powers of two, which need no padding.

Defined results: a null or empty text has only the end id and one piece; rows
with equal doc_id are packed each for itself; an empty table gives no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, batch_of, documents, row_key
from .tokens import BYTE_BPE, encoder, vocabulary_path

LENGTH = 2048
END_ID = 1
#: Documents in a group, on average.
GROUP_DOCS = 1000
#: Groups of a task at most, on average.
TASK_GROUPS = 8


class Rooms:
    """A tournament tree over sequences: each node has the largest room below."""

    def __init__(self, n: int, length: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.best = [length] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """The first sequence with at least ``need`` room; takes it."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < need:
                node += 1
        best[node] -= need
        at = node - self.size
        node >>= 1
        while node:
            best[node] = max(best[2 * node], best[2 * node + 1])
            node >>= 1
        return at


def pack(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces; each id is in exactly one."""
    sequences: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        whole = n // length
        sequences += [[(d, i * length, length)] for i in range(whole)]
        if n % length:
            rest.append((n % length, d, whole * length))
    rest.sort(key=lambda x: (-x[0], x[1]))
    if not rest:
        return sequences
    tree, open_ = Rooms(len(rest), length), []
    for n, d, start in rest:
        at = tree.first_fit(n)
        if at == len(open_):
            open_.append([])
        open_[at].append((d, start, n))
    fill = lambda s: sum(n for _, _, n in s)
    full = [s for s in open_ if fill(s) == length]
    part = sorted((s for s in open_ if fill(s) < length), key=fill, reverse=True)
    lo, hi = 0, len(part) - 1
    room = length - fill(part[0]) if part else 0
    while lo < hi:
        d, start, n = part[hi].pop()
        take = min(n, room)
        part[lo].append((d, start, take))
        room -= take
        if take < n:
            part[hi].append((d, start + take, n - take))
        if not part[hi]:
            hi -= 1
        if not room:
            full.append(part[lo])
            lo += 1
            room = length - fill(part[lo]) if lo <= hi else 0
    if lo <= hi and part[lo]:  # what is left is split at powers of two
        left, size = part[lo], 1 << (fill(part[lo]).bit_length() - 1)
        while left:
            now, room = [], size
            while room:
                d, start, n = left.pop(0)
                take = min(n, room)
                now.append((d, start, take))
                room -= take
                if take < n:
                    left.insert(0, (d, start + take, n - take))
            full.append(now)
            total = fill(left)
            size = 1 << (total.bit_length() - 1) if total else 0
    return sequences + full


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
PIECE_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])


def _packed(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4")

    def group(table: list[tuple[int, list, list]]):
        number, doc_ids, ids = table
        out = {c: [] for c in PIECE_ARROW.names}
        for s, pieces in enumerate(pack([len(x) for x in ids], length)):
            at = 0
            for d, start, n in pieces:
                row = (doc_ids[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), (number << 32) | s, at)
                for c, v in zip(PIECE_ARROW.names, row):
                    out[c].append(v)
                at += n
        return batch_of(PIECE_ARROW, out)

    def run(batches):
        encode, now = encoder(path).encode, None
        doc_ids, ids = [], []
        waiting, held = [], 0

        def learn():
            nonlocal waiting, held
            for (doc, _), found in zip(waiting, encode([t for _, t in waiting])):
                doc_ids.append(doc)
                ids.append(np.concatenate((found, end)))
            waiting, held = [], 0

        for batch in batches:
            for doc, text, number in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is not None and number != now:
                    learn()
                    yield group((now, doc_ids, ids))
                    doc_ids, ids = [], []
                now = number
                waiting.append((doc, text))
                held += len(text)
                if held > SLICE_BYTES:
                    learn()
        if now is not None:
            learn()
            yield group((now, doc_ids, ids))

    return run


def packed(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    spark = docs.sparkSession
    groups = max(1, docs.select(F.lit(1)).count() // group_docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.pmod(row_key(text, F.coalesce("doc_id", F.lit(-1))), F.lit(groups)).alias("group"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups, 12), groups // TASK_GROUPS)
    # Sorted within a task, so that a task that is run again packs alike.
    dealt = rows.repartition(n, "group").sortWithinPartitions("group", "doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(_packed(tokenizer_path, length, end_id), PIECE)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), vocabulary_path(BYTE_BPE))
