"""Document fingerprints from prefix polynomial hashes.

A text's prefix sums of code points times powers of a base, under two primes,
give the hash of any span by one subtraction and one multiplication. A
fingerprint keeps the hashes of the text's prefixes and suffixes at multiples of
a power of two, at most ``MARKS`` of each, with its length and whole hash. Two
fingerprints have their longest common extensions from the front and from the
back found by binary search; likeness is the part of the longer text these cover,
in units of the marks' distance. Marks keep all 62 bits.

Where both texts are at hand, nothing is rounded to marks: any two spans are
compared by ``equal_spans``, ``forward`` and ``backward`` give the longest common
extension of any two places to the character, and ``shared`` goes on after
mismatches: it is the part of both texts' characters that lie in a span of
``SPAN`` characters (or of the shorter text's length) found in the other text.

The edited text of a document is not hashed anew: its prefixes come from the
document's prefix sums and those of the next document.

Defined results: a null text is empty; two empty texts are alike (1), an empty
and another are not (0). Rows with equal doc_id are ordered by their text's hash,
null doc_ids come after all others. A single document is its own next one; an
empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, documents

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
MARKS = 32
#: Code points hashed in one go, and documents in a bucket of the order, on average.
PIECE, BUCKET_DOCS = 1 << 16, 4000
#: Buckets at most: their bounds are in the plan. Beyond them buckets grow; a task reads one in order and holds two texts.
BUCKETS = 20_000
#: Code points of the least span that two texts can share.
SPAN = 16


@lru_cache(maxsize=2)
def _powers(sign: int = 1) -> tuple[np.ndarray, ...]:
    out = []
    for p, b in zip(PRIMES, BASES):
        b = pow(b, sign, p)
        row, have = np.ones(PIECE, np.uint64), 1
        while have < PIECE:  # doubling: powers of the second half from the first
            row[have : 2 * have] = row[:have] * np.uint64(pow(b, have, p)) % np.uint64(p)
            have *= 2
        out.append(row)
    return tuple(out)


class Prefixes:
    """Prefix sums of a text's code points, piece by piece."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.n = codes, len(codes)
        self.sums = [[0], [0]]  # at the start of each piece
        self.now, self.local = -1, None
        self.full = self.keys = None
        for i in range(0, max(1, self.n), PIECE):
            local = self._piece(i // PIECE)
            for m, p in enumerate(PRIMES):
                self.sums[m].append((self.sums[m][-1] + pow(BASES[m], i, p) * int(local[m][-1])) % p)

    def _piece(self, k: int):
        if self.now != k:
            part = self.codes[k * PIECE : (k + 1) * PIECE].astype(np.uint64) + np.uint64(1)
            self.local = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * w[: len(part)] % np.uint64(p)) % np.uint64(p))) for w, p in zip(_powers(), PRIMES)]
            self.now = k
        return self.local

    def at(self, places: np.ndarray) -> np.ndarray:
        """The sums before each of some ascending places, under both primes."""
        out = np.zeros((2, len(places)), np.uint64)
        which = np.minimum(places // PIECE, max(0, (self.n - 1) // PIECE))
        for k in np.unique(which).tolist():
            mine, local = which == k, self._piece(k)
            for m, p in enumerate(PRIMES):
                scale = pow(BASES[m], k * PIECE, p)
                out[m, mine] = (local[m][places[mine] - k * PIECE] * np.uint64(scale) + np.uint64(self.sums[m][k])) % np.uint64(p)
        return out

    def all(self) -> np.ndarray:
        """The sums before every place."""
        if self.full is None:
            self.full = self.at(np.arange(self.n + 1))
        return self.full

    def spans(self, width: int) -> np.ndarray:
        """The hash of every span of ``width`` code points, in order."""
        if width == SPAN and self.keys is not None:
            return self.keys
        sums, count = self.all(), self.n - width + 1
        out = np.zeros(count, np.uint64)
        for m, p in enumerate(PRIMES):
            span = (np.uint64(p) + sums[m, width:] - sums[m, :count]) % np.uint64(p)
            for i in range(0, count, PIECE):
                part = span[i : i + PIECE]
                part[:] = part * _powers(-1)[m][: len(part)] % np.uint64(p) * np.uint64(pow(BASES[m], -i, p)) % np.uint64(p)
            out = (out << np.uint64(32)) | span
        if width == SPAN:
            self.keys = out
        return out


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether ``length`` code points are the same from place i of a and j of b."""
    x, y = a.all(), b.all()
    for m, p in enumerate(PRIMES):
        u, v = int(x[m, i + length]) - int(x[m, i]), int(y[m, j + length]) - int(y[m, j])
        if (u - v if i == j else u * pow(BASES[m], j, p) - v * pow(BASES[m], i, p)) % p:
            return False
    return True


def _longest(most: int, equal) -> int:
    lo, hi = 0, most
    while lo < hi:
        k = (lo + hi + 1) // 2
        lo, hi = (k, hi) if equal(k) else (lo, k - 1)
    return lo


def forward(a: Prefixes, i: int, b: Prefixes, j: int, most: int | None = None) -> int:
    """The longest common extension from place i of a and j of b on."""
    limit = min(a.n - i, b.n - j)
    return _longest(limit if most is None else min(limit, most), lambda k: equal_spans(a, i, b, j, k))


def backward(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """The longest common extension that ends before place i of a and j of b."""
    return _longest(min(i, j), lambda k: equal_spans(a, i - k, b, j - k, k))


def _covered(keys: np.ndarray, among: np.ndarray, width: int) -> int:
    """Places in a span whose key is ``among`` the sorted ones."""
    at = np.flatnonzero(among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys)
    return int(np.minimum(np.diff(at), width).sum()) + width if len(at) else 0


def shared(a: Prefixes, b: Prefixes) -> float:
    """0 to 1: the part of both texts in spans that the other one has too."""
    width = min(SPAN, a.n, b.n)
    if not width:
        return float(a.n == b.n)
    x, y = a.spans(width), b.spans(width)
    return (_covered(x, np.sort(y), width) + _covered(y, np.sort(x), width)) / (a.n + b.n)


def _joined(head: Prefixes, cut: int, tail: Prefixes, places: np.ndarray) -> np.ndarray:
    """Sums of head[:cut] followed by a prefix of ``tail``."""
    inside = places <= cut
    out = np.zeros((2, len(places)), np.uint64)
    out[:, inside] = head.at(places[inside])
    if not inside.all():
        base, rest = head.at(np.array([cut])), tail.at(places[~inside] - cut)
        for m, p in enumerate(PRIMES):
            out[m, ~inside] = (base[m, 0] + rest[m] * np.uint64(pow(BASES[m], cut, p))) % np.uint64(p)
    return out


def _spans(sums: np.ndarray, places: np.ndarray, whole: np.ndarray, n: int, step: int) -> np.ndarray:
    """Hashes of the spans from each place (n minus multiples of step) to the end."""
    out = np.zeros(len(places), np.uint64)
    for m, p in enumerate(PRIMES):
        back, up, scale = pow(BASES[m], -n, p), pow(BASES[m], step, p), []
        for _ in range(len(places)):
            back = back * up % p
            scale.append(back)
        span = (np.uint64(p) + whole[m, 0] - sums[m]) % np.uint64(p) * np.array(scale, np.uint64) % np.uint64(p)
        out = (out << np.uint64(32)) | span
    return out


def fingerprint(n: int, at) -> str:
    """``at`` gives prefix sums at ascending places of a text of n code points."""
    step = 1
    while n // step > MARKS:
        step *= 2
    count = n // step
    front = np.arange(1, count + 1) * step
    behind = n - front  # descending
    sums, whole = at(front), at(np.array([n]))
    prefix = (sums[0] << np.uint64(32)) | sums[1]
    suffix = _spans(at(behind[::-1])[:, ::-1], behind, whole, n, step)
    marks = lambda x: "".join(f"{v:016x}" for v in x.tolist())
    return f"{n}:{int(whole[0, 0]):08x}{int(whole[1, 0]):08x}:{marks(prefix)}:{marks(suffix)}"


def _common(a: str, b: str, step_a: int, step_b: int) -> int:
    """The longest common extension in marks' units of the wider step."""
    step = max(step_a, step_b)
    lo, hi = 0, min(len(a) // 16 * step_a, len(b) // 16 * step_b) // step
    while lo < hi:
        k = (lo + hi + 1) // 2
        i, j = k * step // step_a, k * step // step_b
        if a[16 * i - 16 : 16 * i] == b[16 * j - 16 : 16 * j]:
            lo = k
        else:
            hi = k - 1
    return lo * step


def likeness(a: str, b: str) -> float:
    """0 to 1: how much of the longer text the common front and back cover."""
    if a == b:
        return 1.0
    (n, _, fa, ba), (m, _, fb, bb) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if not n or not m:
        return 0.0
    width = lambda n: 1 << max(0, (n // (MARKS + 1)).bit_length())
    sa, sb = width(n), width(m)
    return min(1.0, (_common(fa, fb, sa, sb) + _common(ba, bb, sa, sb)) / max(n, m))


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, front_edited bigint, back_edited bigint, front_next bigint, back_next bigint, shared_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), *((c, pa.int64()) for c in ("front_edited", "back_edited", "front_next", "back_next")), ("shared_next", pa.float64())])


class Document:
    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.prefixes = Prefixes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        self.fingerprint = fingerprint(self.prefixes.n, self.prefixes.at)

    def row(self, nxt: "Document") -> tuple:
        n = self.prefixes.n
        taken = min(n // 3, nxt.prefixes.n)
        cut = n - n // 3
        edited = fingerprint(cut + taken, lambda places: _joined(self.prefixes, cut, nxt.prefixes, places))
        sha = hashlib.sha256((self.text[:cut] + nxt.text[:taken]).encode()).hexdigest()
        a, b = self.prefixes, nxt.prefixes
        front = cut + forward(a, cut, b, 0, taken)
        back = backward(a, n, b, taken)
        if back == taken:
            back += backward(a, n - taken, a, cut)
        exact = front, back, forward(a, 0, b, 0), backward(a, n, b, b.n), shared(a, b)
        return self.doc_id, n, sha, self.fingerprint, edited, likeness(self.fingerprint, edited), likeness(self.fingerprint, nxt.fingerprint), *exact


def _bucket(batches, splits, to):
    """Rows with their bucket; a bucket's head once more, to follow the bucket before."""
    schema = pa.schema([("bucket", pa.int32()), ("tail", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])
    for batch in batches:
        place = batch.column(1).to_numpy(zero_copy_only=False)
        bucket = np.searchsorted(splits, place, side="right").astype(np.int32)
        zero = np.zeros(len(place), np.int32)
        yield batch_of(schema, {"bucket": bucket, "tail": zero, "place": batch.column(1), "doc_id": batch.column(0), "text": batch.column(2)})
        heads = [(i, to[p]) for i, p in enumerate(place.tolist()) if p in to]
        if heads:
            part = batch.take(pa.array([i for i, _ in heads]))
            yield batch_of(schema, {"bucket": [b for _, b in heads], "tail": [1] * len(heads), "place": part.column(1), "doc_id": part.column(0), "text": part.column(2)})


def _rows(batches):
    """Consecutive rows of a bucket are a document and its next one."""
    last = bucket = None
    done = False
    for batch in batches:
        out = []
        for b, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b != bucket:
                last, bucket, done = None, b, False
            if done:
                continue
            now = Document(doc_id, text)
            if last is not None:
                out.append(last.row(now))
            last, done = (None, True) if tail else (now, False)
        yield batch_of(_OUT, {c: [r[i] for r in out] for i, c in enumerate(_OUT.names)})


def fingerprinted(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """One row for each document, with the likeness to its edited text and to the next."""
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = docs.select(place.alias("place"))
    n = ids.count()
    wanted = min(max(1, n // bucket_docs), BUCKETS)
    cuts = [i / wanted for i in range(1, wanted)]
    found = ids.agg(F.percentile_approx("place", cuts, max(10_000, 4 * wanted)).alias("s")).first()["s"] if cuts and n else []
    splits = np.array(sorted(set(found or [])), np.int64)

    def numbered(batches):
        schema = pa.schema([("bucket", pa.int32()), ("place", pa.int64())])
        for batch in batches:
            yield batch_of(schema, {"bucket": np.searchsorted(splits, batch.column(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32), "place": batch.column(0)})

    # One row for each bucket, whose number is a parameter's.
    heads = sorted((r.bucket, r.head) for r in ids.mapInArrow(numbered, "bucket int, place bigint").groupBy("bucket").agg(F.max("place").alias("head")).collect())
    to = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    rows = docs.select("doc_id", place.alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.mapInArrow(lambda b: _bucket(b, splits, to), "bucket int, tail int, place bigint, doc_id bigint, text string")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("place").desc(), F.xxhash64("text"))
    return placed.select("bucket", "tail", "doc_id", "text").mapInArrow(_rows, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprinted(documents(spark, sf_dir))
