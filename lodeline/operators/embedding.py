"""Embedders: what turns texts into vectors."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval

#: Texts that a model is given at once: one that runs in the task, one behind a network.
LOCAL_BATCH, HOSTED_BATCH = 16, 96
#: Calls before a batch fails, and seconds of waiting, which grow with each call.
TRIES, WAIT = 3, 1.5


class Embedder(Protocol):
    """A provider's model; vectors of two models are never compared."""

    provider: str
    model: str
    dims: int

    def vectors(self, texts: DataFrame, key: str, text: str, kind: str = "passage") -> DataFrame:
        """(key, embedding) of texts; ``kind`` is passage or query."""


class HashEmbedder:
    """Signed counts of hashed words."""

    provider, model, dims = "hash", "hash-256", retrieval.DIMS

    def vectors(self, texts: DataFrame, key: str, text: str, kind: str = "passage") -> DataFrame:
        return retrieval.hash_vectors(texts, key, text)


def in_order(replies: list) -> list:
    """Vectors by the index that each came with, if they came with one."""
    replies = list(replies)
    if not replies or not isinstance(replies[0], dict):
        return replies
    if sorted(r["index"] for r in replies) != list(range(len(replies))):
        raise ValueError("The model's vectors do not have one index for each text.")
    return [r["embedding"] for r in sorted(replies, key=lambda r: r["index"])]


class ModelEmbedder:
    """Any model: ``embed`` takes a list of texts and gives as many vectors, in
    their order, or as {"index", "embedding"} in any order. It
    is called in tasks, a batch at a time, again after a failure, and its
    vectors are checked for their width and divided by their length."""

    def __init__(self, provider: str, model: str, dims: int, embed: Callable[[list[str]], list], batch: int = LOCAL_BATCH, tries: int = TRIES, wait: float = WAIT):
        self.provider, self.model, self.dims = provider, model, dims
        self.embed, self.batch, self.tries, self.wait = embed, batch, tries, wait

    def vectors(self, texts: DataFrame, key: str, text: str, kind: str = "passage") -> DataFrame:
        embed, size, tries, wait, dims = self.embed, self.batch, self.tries, self.wait, self.dims

        def unit(texts: list[str]) -> list:
            for turn in range(1, tries + 1):
                try:
                    found = np.array(in_order(embed(texts)), np.float64)
                    break
                except Exception:
                    if turn == tries:
                        raise
                    time.sleep(wait * turn)
            if found.shape != (len(texts), dims):
                raise ValueError(f"The model gave vectors of shape {found.shape}, not {(len(texts), dims)}.")
            length = np.sqrt((found**2).sum(axis=1, keepdims=True))
            return (found / np.where(length == 0, 1, length)).astype(np.float32).tolist()

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, size):
                    part = batch.slice(k, size)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(unit([x or "" for x in part.column(1).to_pylist()]), pa.list_(pa.float32()))], names=[key, "embedding"])

        prefixed = T.model_prefix(F.col(text), self.model, kind)
        return texts.select(key, prefixed.alias("_text")).mapInArrow(run, f"{key} bigint, embedding array<float>")
