"""The best few of many rows for each question, in tasks and across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _order(lists: np.ndarray, values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Lists together, each by values rounded to six decimals, then by ids."""
    whole = np.rint(np.where(np.isfinite(values), values, 0) * 1e6).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    least, span = whole.min(initial=0), np.ptp(whole) + 2 if len(whole) else 1
    if (int(lists.max(initial=0)) + 1) * int(span) >= 1 << 62:
        return np.lexsort((ids, np.round(values, 6), lists))
    # One number has list and value; what is infinite comes last.
    key = lists * span + np.where(np.isfinite(values), whole - least, span - 1)
    return order[np.argsort(key[order], kind="stable")]


def marked(mark: np.ndarray) -> np.ndarray:
    """Where a table of booleans, few of them true, is true; its size is a multiple of 8."""
    some = np.flatnonzero(mark.reshape(-1).view(np.uint64))
    row, at = np.nonzero(mark.reshape(-1, 8)[some])
    return some[row] * 8 + at


class Least:
    """The ``top`` least values seen so far in each of ``many`` lists; ties of
    values rounded to six decimals go to the lesser id."""

    def __init__(self, many: int, top: int):
        self.top = top
        self.values, self.ids = np.full((many, top), np.inf), np.zeros((many, top), np.int64)

    def add(self, lists: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """More of some lists, each id once in a list."""
        some, lists = np.unique(lists, return_inverse=True)
        lists = np.concatenate([np.repeat(np.arange(len(some)), self.top), lists])
        values, ids = np.concatenate([self.values[some].ravel(), values]), np.concatenate([self.ids[some].ravel(), ids])
        order = _order(lists, values, ids)
        best = order[np.searchsorted(lists[order], np.arange(len(some)))[:, None] + np.arange(self.top)]
        self.values[some], self.ids[some] = values[best], ids[best]

    def rows(self, step: int = 2000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(list, id, value), some lists at a time."""
        for k in range(0, len(self.ids), step):
            some, place = np.nonzero(np.isfinite(self.values[k : k + step]))
            yield k + some, self.ids[k + some, place], self.values[k + some, place]


def ranked(rows: DataFrame, value: str, top: int) -> DataFrame:
    """question_id, chunk_id, ``value`` and rank of the ``top`` least values of
    each question, ties to the lesser chunk_id. Each task told its best: these
    meet by question, and are put in order a few questions at a time."""
    names = ["question_id", "chunk_id", value, "rank"]

    def first(some: pa.Table) -> pa.RecordBatch:
        question, ids, values = (some.column(c).to_numpy() for c in range(3))
        lists = np.cumsum(np.append(0, question[1:] != question[:-1]))
        order = np.lexsort((ids, values, lists))
        begins = np.searchsorted(lists, np.arange(lists[-1] + 1))
        place = np.arange(len(lists)) - begins[lists]  # lists lie together, before and after
        keep = place < top
        order, place = order[keep], place[keep]
        return pa.RecordBatch.from_arrays([pa.array(question[order]), pa.array(ids[order]), pa.array(values[order]), pa.array(place + 1, pa.int32())], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # A question's rows may go on in the next batch.
            question = batch.column(0).to_numpy()
            if not len(question):
                continue
            seam = int(np.searchsorted(question, question[-1]))
            if seam or held and held[-1].column(0)[-1].as_py() != question[-1]:
                held.append(batch.slice(0, seam))
                yield first(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(seam))
        if held:
            yield first(pa.Table.from_batches(held))

    together = rows.select(*names[:3]).repartition("question_id").sortWithinPartitions("question_id")
    return together.mapInArrow(run, f"question_id bigint, chunk_id bigint, {value} double, rank int")
