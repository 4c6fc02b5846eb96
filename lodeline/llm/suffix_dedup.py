"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere
else. Sorting all suffixes would move every byte a hundred times, so suffixes
are sorted at anchors only (see ``anchors``), and only at those whose first
bytes occur more than once:

1. Anchors are found in every text and their grams counted by grouped
   aggregation; a gram that occurs once has no repeated window.
2. Each task sorts the suffixes at the remaining anchors of its documents into
   runs, one for each target, front-coded, equal contexts once. Runs are
   exchanged by gram.
3. A target merges its runs with loser trees that go on from known common
   prefixes. The agreement of neighbours tells, for each window at an offset
   before the anchor, which anchors share its right part; what stands left of
   the anchor splits these classes further, byte by byte. A window in a class
   with another one is repeated. No pair of occurrences is ever listed.
4. Repeated windows go back to their documents as intervals.

A gram that occurs very often would bring all its suffixes to one target. Those of
grams that occur more than ``HOT`` times go by longer strings instead: a window's
offset before its anchor falls in one of several bands, and what all windows of a
band have in common, nearly the whole window, is the gram by which the suffix
travels, once for each band. So places of a frequent phrase part by what stands
around it, and only those that stand in nearly the same window meet. They are
sorted and merged like all others.

Defined results: a null text is empty; texts shorter than a window stay as they
are; equal rows repeat each other; an empty table gives none. Rows are known by
128 bits of doc_id and text, so null or repeated doc_ids are safe. A very long text
is anchored in one go and comes alone; a window is from ``GRAM`` to 255 bytes. Other columns are ignored,
except by ``deduplicated``, which returns them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, anchors
from .common import batch_of, documents, long_row_key, slices, stored
from .sorted_runs import common_prefixes, decoded, front_coded, merged

WINDOW = 200
#: Suffixes that a task sorts at once; occurrences of a gram from which it goes by longer strings; offsets in a band of these.
SORTED, HOT, BAND = 1 << 15, 20_000, 16
#: Suffixes of a target, on average: what is merged at once.
TARGET = 16_384

#: place: the anchor's byte, then eight bits each for its windows' least and greatest offset before it.
_ANCHOR = pa.schema([("k", pa.binary()), ("gram", pa.int64()), ("place", pa.int64())])
_GRAM = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
_RUN = pa.schema(
    [("target", pa.int32()), ("n", pa.int32()), ("shared", pa.binary()), ("rests", pa.binary()), ("left", pa.binary()), ("shape", pa.binary()), ("owner", pa.binary()), ("place", pa.binary())]
)
RUNS = "target int, n int, shared binary, rests binary, left binary, shape binary, owner binary, place binary"
_SPAN = pa.schema([("k", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())])


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_PACK = pa.Codec("zstd", compression_level=1)


def _squeezed(x: bytes) -> bytes:
    """The size, then the bytes compressed."""
    return len(x).to_bytes(8, "little") + _PACK.compress(x, asbytes=True)


def _whole(x: bytes) -> bytes:
    return _PACK.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)


def _pack(batches):
    """Texts compressed one by one, as they are shuffled twice."""
    for batch in batches:
        i = batch.schema.get_field_index("text")
        found = [_squeezed(t) for t in _raw(batch.column(i))]
        yield batch.set_column(i, "text", pa.array(found, pa.binary()))


def _unpacked(column: pa.Array) -> list[bytes]:
    return [_whole(x) for x in column.to_pylist()]


def packed(df: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(_pack, schema)


def _grams(window: int):
    def run(batches):
        for batch in slices(batches, "text"):
            _, hashes, _, _ = anchors(*_laid(_raw(batch.column(0))), window)
            found, n = np.unique(hashes, return_counts=True)
            yield batch_of(_GRAM, {"gram": found.view(np.int64), "n": n})

    return run


def _anchored(window: int):
    def run(batches):
        for batch in slices(batches, "text"):
            buf, starts = _laid(_raw(batch.column(1)))
            at, hashes, lo, hi = anchors(buf, starts, window)
            owner = np.searchsorted(starts, at, side="right") - 1
            k = batch.column(0).take(pa.array(owner, pa.int64()))
            yield batch_of(_ANCHOR, {"k": k, "gram": hashes.view(np.int64), "place": ((at - starts[owner]) << 16) | ((at - hi) << 8) | (at - lo)})

    return run


def _parted(buf: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For anchors of a frequent gram: each once for every band of offsets that
    its windows have, with the offsets in that band and the hash of what all
    windows of the band hold. Returns which anchor, least and greatest offset, and hash."""
    which, lo, hi, grams = [], [], [], []
    for band in range(0, window - GRAM + 1, BAND):
        last = min(band + BAND, window - GRAM + 1) - 1
        mine = np.flatnonzero((low <= last) & (high >= band))
        if not len(mine):
            continue
        held = buf[(at[mine] - band)[:, None] + np.arange(window - last + band)]
        grams += [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8, salt=bytes([band])).digest(), "little", signed=True) for x in held]
        which.append(mine)
        lo.append(np.maximum(low[mine], band))
        hi.append(np.minimum(high[mine], last))
    return np.concatenate(which), np.concatenate(lo), np.concatenate(hi), np.array(grams, np.int64)


def _runs(window: int, targets: int):
    """Sorted front-coded runs of (right context; left context, offsets) for each target."""

    def close(target, rows, left, shape, owner, place):
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
        shared, rests = front_coded(rows[order])
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        return {"target": target, "n": len(order), "shared": shared.astype(np.uint8).tobytes(), "rests": rests, "left": left[order].tobytes(), "shape": shape[order].tobytes(), "owner": owner.tobytes(), "place": np.stack((to[place[:, 0]], place[:, 1]), axis=1).tobytes()}

    def run(batches):
        reach = window - GRAM
        held, n_held = [], 0

        def flush():
            nonlocal held, n_held
            rows, left, shape, owner, gram, at = (np.concatenate([h[i] for h in held]) for i in range(6))
            held, n_held = [], 0
            target = (gram.view(np.uint64) % np.uint64(targets)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
                whole = np.ascontiguousarray(np.concatenate((rows[mine], left[mine], shape[mine].view(np.uint8).reshape(len(mine), -1)), axis=1))
                # Equal contexts are one record with all its places.
                _, first, which = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
                pick = mine[first]
                out = close(int(target[mine[0]]), rows[pick], left[pick], shape[pick], owner[mine], np.stack((which.ravel(), at[mine]), axis=1))
                yield batch_of(_RUN, {c: [_squeezed(out[c]) if isinstance(out[c], bytes) else out[c]] for c in _RUN.names})

        for batch in slices(batches, "text"):
            for k, text, found in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), batch.column(2).to_pylist()):
                buf = np.frombuffer(bytes(reach) + text + bytes(window), np.uint8)
                place, gram, hot = (np.array([f[c] for f in found]) for c in ("place", "gram", "hot"))
                at, low, high = (place >> 16) + reach, (place >> 8) & 255, place & 255
                if hot.any():
                    h, c = np.flatnonzero(hot), np.flatnonzero(~hot)
                    which, lo, hi, keys = _parted(buf, at[h], low[h], high[h], window)
                    at, low, high, gram = np.concatenate((at[c], at[h][which])), np.concatenate((low[c], lo)), np.concatenate((high[c], hi)), np.concatenate((gram[c], keys))
                rows = buf[at[:, None] + np.arange(window)]
                left = buf[at[:, None] - 1 - np.arange(reach)]
                shape = np.stack((low, high), axis=1).astype(np.int16)
                # Bytes that no window of this anchor covers do not count.
                rows = np.where(np.arange(window)[None, :] < window - shape[:, :1], rows, 0)
                left = np.where(np.arange(reach)[None, :] < shape[:, 1:], left, 0)
                held.append((rows, left, shape, np.full(len(at), np.void(k)), gram, at - reach))
                n_held += len(at)
                if n_held >= SORTED:
                    yield from flush()
        if n_held:
            yield from flush()

    return run


def repeated_offsets(agree: np.ndarray, left: np.ndarray, shape: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """Of sorted right contexts with their agreement, left contexts (backwards)
    and window offsets: for each record and offset, whether its window is
    found again. Classes by left context are split byte by byte."""
    m, reach = left.shape
    out = np.zeros((m, reach + 1), bool)
    leftward = np.zeros(m, np.int64)
    for o in range(reach + 1):
        if o:
            # Once a left class has one member it stays so; classes are renumbered densely.
            _, leftward = np.unique(leftward * 256 + left[:, o - 1], return_inverse=True)
        use = np.flatnonzero((shape[:, 0] <= o) & (o <= shape[:, 1]))
        if not len(use):
            continue
        right = np.cumsum(agree < window - o)[use]
        both = right * (int(leftward.max()) + 1) + leftward[use]
        _, which = np.unique(both, return_inverse=True)
        total = np.bincount(which, weights=copies[use])
        out[use, o] = total[which] > 1
    return out


def _merged(window: int):
    reach = window - GRAM

    def spans(runs: list[dict]):
        if not runs:
            return
        parts = []
        for r in runs:
            shared = np.frombuffer(r["shared"], np.uint8).astype(np.int64)
            parts.append((decoded(shared, r["rests"], window), shared))
        base = np.concatenate(([0], np.cumsum([r["n"] for r in runs])))
        left = np.concatenate([np.frombuffer(r["left"], np.uint8).reshape(-1, reach) for r in runs])
        shape = np.concatenate([np.frombuffer(r["shape"], np.int16).reshape(-1, 2) for r in runs]).astype(np.int64)
        owner = np.concatenate([np.frombuffer(r["owner"], "V16") for r in runs])
        place = np.concatenate([np.frombuffer(r["place"], np.int64).reshape(-1, 2) + [[b, 0]] for r, b in zip(runs, base)])
        copies = np.bincount(place[:, 0], minlength=int(base[-1]))
        order, agree = merged(parts)
        again = np.zeros((len(order), reach + 1), bool)
        again[order] = repeated_offsets(agree, left[order], shape[order], copies[order], window)
        # Runs of repeated offsets o..p before an anchor are window starts at-p..at-o.
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        rec, begin = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        first = np.searchsorted(rec, np.arange(len(order) + 1))
        many = np.diff(first)[place[:, 0]]
        row = np.repeat(np.arange(len(place)), many)
        which = first[place[row, 0]] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = place[row, 1]
        yield batch_of(_SPAN, {"k": [x.tobytes() for x in owner[row]], "lo": at - stop[which] + 1, "hi": at - begin[which] + window})

    def run(batches):
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["target"] != now:
                    yield from spans(held)
                    now, held = r["target"], []
                held.append({c: _whole(x) if isinstance(x, bytes) else x for c, x in r.items()})
        yield from spans(held)

    return run


def spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """k (a row's key) and the list of its intervals of repeated bytes, for
    rows that have any. ``docs``: k, text."""
    texts = docs.select("text")
    if not GRAM <= window <= 255:
        raise ValueError(f"A window has from {GRAM} to 255 bytes.")
    counts = texts.mapInArrow(_grams(window), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = stored(counts, "grams")
    light = docs.select("k", "text").mapInArrow(_anchored(window), "k binary, gram bigint, place bigint")
    wanted = light.join(counts, "gram").groupBy("k").agg(F.collect_list(F.struct("gram", "place", (F.col("n") > hot).alias("hot"))).alias("found"))
    # As many targets as there are suffixes for; a task merges several, one after the other.
    targets = max(12, int(counts.agg(F.sum("n")).first()[0] or 0) // TARGET)
    runs = packed(docs.select("k", "text")).join(wanted, "k").select("k", "text", "found").mapInArrow(_runs(window, targets), RUNS)
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), targets // 16)
    found = runs.repartition(parts, "target").sortWithinPartitions("target").mapInArrow(_merged(window), "k binary, lo bigint, hi bigint")
    return found.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def kept_bytes(text: bytes, found: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the maximal runs removed."""
    if not found:
        return text, 0, 0
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, [f["lo"] for f in found], 1)
    np.add.at(cover, [f["hi"] for f in found], -1)
    gone = np.cumsum(cover)[:-1] > 0
    runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digests(batches):
    for batch in slices(batches, "text"):
        out = {c: [] for c in _OUT.names[1:]}
        for text, found in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
            left, removed, runs = kept_bytes(text, found)
            for c, v in zip(_OUT.names[1:], (len(text), removed, runs, hashlib.sha256(left).hexdigest())):
                out[c].append(v)
        yield batch_of(_OUT, {"doc_id": batch.column(0)} | out)


def _cut(batches):
    for batch in slices(batches, "text"):
        text = [kept_bytes(t, found)[0].decode("utf-8", "ignore") for t, found in zip(_unpacked(batch.column(batch.schema.get_field_index("text"))), batch.column(batch.schema.get_field_index("_spans")).to_pylist())]
        keep = [c for c in batch.schema.names if c not in ("_spans",)]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in keep], names=keep)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of doc_id and text, and one row for all equal ones' sake."""
    return docs.withColumn("_k", long_row_key(F.coalesce("text", F.lit("")), F.col("doc_id")))


def _with_spans(docs: DataFrame, window: int, hot: int) -> DataFrame:
    keyed = _keyed(docs)
    found = spans(keyed.select(F.col("_k").alias("k"), F.coalesce("text", F.lit("")).alias("text")), window, hot).select(F.col("k").alias("_k"), F.col("spans").alias("_spans"))
    return packed(keyed).join(found, "_k", "left")


def removed(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row."""
    out = _with_spans(docs.select("doc_id", "text"), window, hot).select("doc_id", "text", "_spans")
    return out.mapInArrow(_digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """All documents without their repeated bytes (a code point that loses a
    byte goes whole); n_chars, if present, is counted anew."""
    joined = _with_spans(docs, window, hot).select(*docs.columns, "_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = joined.mapInArrow(_cut, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))
