"""Near-duplicate groups by one-permutation MinHash.

Every text's set of word shingles is hashed once; the least hash in each of 128
bins, empty bins filled by optimal densification, is its signature. Equal sets
are one from then on. Bands of the signature are buckets; in each, a star of
candidate edges leads from the least id to the others. Edges that length and,
between large sets, a one-bit sketch do not rule out are confirmed on the full
sets, and connected.

A star tests its centre only. So that no link between two others of a bucket is
lost, buckets whose members are not all in one component are gone through
again, in blocks of bounded size: pairs of different components, each in the
first bucket that it shares, pass the same filters. Blocks are made twice: first
with parities only, which leaves members that may have a link there; of these, sets
too small for the sketch go through the blocks with their members, a few kB each, and
are compared there; of larger ones only the sketch does, and for the few pairs that it
leaves the full sets are fetched. So what leaves a block are links, or pairs that very
likely are.

A set's parities, two bits or more for a shingle up to 2,048 of them, tell which of as
many cells hold an odd number of its shingles. Where those of two sets differ, the sets
do, so they bound the difference from below and rule out no link; full sets are fetched
only for pairs that they leave.

Buckets are found in one shuffle of keys and 64-bit names of sets; all later steps read
only members of buckets that have several. Two sets of one such name would be taken for
members of each other's buckets, which adds pairs to be judged and loses none but theirs.

A set so small that the threshold allows it to differ from a larger one in a single
shingle (up to seven at 0.8) has no bands, since one common shingle would bring it into
many buckets. Its only partners are equal sets, and sets that have one shingle more:
these name themselves without each of their shingles in turn, and meet it by equality.

A pair at exactly the threshold shares no bucket with probability
(1 - s**4)**32, 5e-8 at 0.8; the sketch rules it out with about 1e-6 where both
sets have ``SKETCH_LEAST`` shingles. Smaller sets fill many bins with few hashes,
so their sketches say too little: they are always confirmed in full.

Defined results: a null text or one without words has an empty set and is linked
with nothing; a text with fewer words than a shingle is one shingle. A row with a
null doc_id stands alone: its component is null and it is kept. Equal rows are
linked. Rows with one doc_id and different texts are judged each by its own text;
of those in one group ``one_of_each`` keeps the one of least text hash, and of
equal rows one. A very long text has one set. An empty table gives none; further
columns are ignored, except by ``one_of_each``, which returns them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, documents, slices, stored
from .components import components
from .oph import BINS, band_keys, digest, signature, sketch
from .shingles import differ_at_most, folded, jaccard_at_least, parities, shingle_sets

SHINGLE_WORDS, PERCENT = 5, 80
BAND_ROWS = 4
#: Sketch bits that may differ: at similarity 0.8, 12.8 do on average, with a deviation of 3.4.
SKETCH_DIFFERS = 30
#: Shingles that both sets need before the sketch may rule a pair out.
SKETCH_LEAST = 512
#: Members in a block of a mixed bucket; digests up to which a set of them is broadcast (16 bytes each).
BLOCK, BROADCAST_IDS = 2048, 500_000

SIGNED = "doc_id bigint, th bigint, n_shingles bigint, digest binary, bands array<bigint>, s1 bigint, s2 bigint, less array<binary>, odd binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("s1", pa.int64()), ("s2", pa.int64()), ("less", pa.list_(pa.binary())), ("odd", pa.binary())])


def differs_by_one(n: int, percent: int) -> bool:
    """Whether sets of n shingles and of more that are alike enough differ in
    one at most: in n (100 - percent) / percent of them."""
    return n * (100 - percent) // percent <= 1


def _bytes(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [x or b"" for x in batch.column(i).cast(pa.binary()).to_pylist()]


def _signed(words: int, rows: int, percent: int):
    def run(batches):
        for batch in slices(batches, "text"):
            out = {c: [] for c in _SIGNED.names[2:]}
            for s in shingle_sets(_bytes(batch, 1), words):
                out["n_shingles"].append(len(s))
                if not len(s):
                    for c in _SIGNED.names[3:]:
                        out[c].append(None)
                    continue
                sig, n = signature(s, BINS), len(s)
                low, high = sketch(sig).tolist()
                bands = [] if differs_by_one(n, percent) else band_keys(sig, rows).view(np.int64)
                less = [digest(np.delete(s, i)) for i in range(n)] if differs_by_one(n - 1, percent) and 100 * (n - 1) >= percent * n else None
                for c, v in (("digest", digest(s)), ("bands", bands), ("s1", low), ("s2", high), ("less", less), ("odd", parities(s))):
                    out[c].append(v)
            yield batch_of(_SIGNED, {"doc_id": batch.column(0), "th": batch.column(2)} | out)

    return run


def _sets(words: int):
    schema = pa.schema([("id", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        for batch in slices(batches, "text"):
            yield batch_of(schema, {"id": batch.column(0), "shingles": [s.tobytes() for s in shingle_sets(_bytes(batch, 1), words)]})

    return run


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _confirmed(percent: int):

    def run(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent):
                    out.append((a, b))
            yield batch_of(_PAIR, {"a": [a for a, _ in out], "b": [b for _, b in out]})

    return run


def _possible(percent: int):
    """The pairs whose parities leave the threshold possible."""

    def run(batches):
        for batch in batches:
            out = []
            for a, b, n, m, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                size = min(len(x), len(y))
                apart = int.from_bytes(folded(x, size)) ^ int.from_bytes(folded(y, size))
                if differ_at_most(apart.bit_count(), n + m, percent):
                    out.append((a, b))
            yield batch_of(_PAIR, {"a": [a for a, _ in out], "b": [b for _, b in out]})

    return run


def _few(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if counted to be few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets_of(docs: DataFrame, named: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The shingle sets whose digests are in ``ids`` (stored, column id), each
    from one text. ``named``: a doc_id and text hash for each digest."""
    wanted = _few(named.join(_few(ids), "id", "left_semi"))
    mine = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(wanted, ["doc_id", "th"])
    return mine.dropDuplicates(["doc_id", "th"]).select("id", "text").mapInArrow(_sets(words), "id binary, shingles binary")


def plausible(a1, a2, an, b1, b2, bn, percent: int):
    """Whether length and, between large sets, sketch leave the threshold possible."""
    apart = F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))
    return (100 * F.least(an, bn) >= percent * F.greatest(an, bn)) & ((F.least(an, bn) < SKETCH_LEAST) | (apart <= SKETCH_DIFFERS))


_FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sure", pa.bool_())])


_WORTH = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("id", pa.binary()), ("comp", pa.binary())])


def _blocks(batches):
    """The rows of each block (key, i, j), which come together, if there are several."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != now:
                if len(held) > 1:
                    yield held
                now, held = row[:3], []
            held.append(row)
    if len(held) > 1:
        yield held


def _worth(percent: int):
    """Of blocks' rows (key, i, j, side, id, comp, n, s1, s2, odd), sorted by (key, i, j),
    those with another of a different component that length, sketch and parities leave possible."""

    def kept(rows: list[tuple]):
        _, i, j = rows[0][:3]
        side, n, s1, s2 = (np.array([r[k] for r in rows], np.int64) for k in (3, 6, 7, 8))
        comp = np.unique(np.array([r[5] for r in rows], "V16"), return_inverse=True)[1].ravel()
        bits = np.array([len(r[9]) for r in rows])
        by_size = {}  # the parities of all that have so many bytes or more, folded to these
        for size in np.unique(bits).tolist():
            by_size[size] = np.zeros((len(rows), size // 8), np.uint64)
            for x in np.flatnonzero(bits >= size).tolist():
                by_size[size][x] = np.frombuffer(folded(rows[x][9], size), np.uint64)
        keep = np.zeros(len(rows), bool)
        for x in np.flatnonzero(side == i).tolist():
            other = (side == j) & (comp != comp[x])
            if i == j:
                other[: x + 1] = False
            ys = np.flatnonzero(other)
            ys = ys[100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x])]
            apart = np.bitwise_count((s1[ys] ^ s1[x]).view(np.uint64)) + np.bitwise_count((s2[ys] ^ s2[x]).view(np.uint64))
            ys = ys[(np.minimum(n[ys], n[x]) < SKETCH_LEAST) | (apart <= SKETCH_DIFFERS)]
            both = np.minimum(bits[ys], bits[x])
            for size in np.unique(both).tolist():
                at, odd = ys[both == size], by_size[size]
                at = at[differ_at_most(np.bitwise_count(odd[at] ^ odd[x]).sum(axis=1, dtype=np.int64), n[at] + n[x], percent)]
                keep[at] = True
                keep[x] |= len(at) > 0
        left = [rows[x] for x in np.flatnonzero(keep).tolist()]
        return batch_of(_WORTH, {c: [r[k] for r in left] for k, c in enumerate(_WORTH.names)})

    return lambda batches: (kept(rows) for rows in _blocks(batches))


def _in_blocks(percent: int):
    """Links between components, and pairs of large sets that may be some, inside
    blocks of mixed buckets; rows (key, i, j, side, id, comp, n, s1, s2, bands,
    band, shingles) come sorted by (key, i, j)."""

    def pairs(rows: list[tuple]):
        _, i, j = rows[0][:3]
        side, n, s1, s2 = (np.array([r[k] for r in rows], np.int64) for k in (3, 6, 7, 8))
        ids, band = [r[4] for r in rows], rows[0][10]
        comp = np.unique(np.array([r[5] for r in rows], "V16"), return_inverse=True)[1].ravel()
        bands = np.array([r[9] for r in rows], np.int64)
        out = []
        for x in np.flatnonzero(side == i).tolist():
            other = (side == j) & (comp != comp[x])
            if i == j:
                other[: x + 1] = False
            ys = np.flatnonzero(other)
            ys = ys[100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x])]
            small = np.minimum(n[ys], n[x]) < SKETCH_LEAST
            apart = np.bitwise_count((s1[ys] ^ s1[x]).view(np.uint64)) + np.bitwise_count((s2[ys] ^ s2[x]).view(np.uint64))
            keep = small | (apart <= SKETCH_DIFFERS)
            ys, small = ys[keep], small[keep]
            if not len(ys):
                continue
            first = (bands[ys] == bands[x]).argmax(axis=1) == band  # the first band they share
            ys, small = ys[first], small[first]
            found = [(y, False) for y in ys[~small].tolist()]
            ys = ys[small]
            if len(ys):
                mine = np.frombuffer(rows[x][11], np.uint64)
                joined, sizes = np.frombuffer(b"".join([rows[y][11] for y in ys.tolist()]), np.uint64), n[ys]
                hit = mine[np.minimum(np.searchsorted(mine, joined), len(mine) - 1)] == joined
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
                found += [(y, True) for y in ys[100 * both >= percent * (len(mine) + sizes - both)].tolist()]
            out += [(min(ids[x], ids[y]), max(ids[x], ids[y]), sure) for y, sure in found]
        return batch_of(_FOUND, {c: [p[k] for p in out] for k, c in enumerate(_FOUND.names)})

    return lambda batches: (pairs(rows) for rows in _blocks(batches))


def _linked(docs: DataFrame, reps: DataFrame, edges: DataFrame, words: int, percent: int, label: str) -> DataFrame:
    """Those candidate edges (stored: a, b) whose full sets are alike enough."""
    met = stored(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), f"{label}-met")
    odd = reps.select("id", "n", "odd").join(_few(met), "id", "left_semi")
    pairs = edges.join(odd.toDF("b", "m", "y"), "b").join(odd.toDF("a", "n", "x"), "a").select("a", "b", "n", "m", "x", "y")
    edges = stored(pairs.mapInArrow(_possible(percent), "a binary, b binary"), f"{label}-possible")
    ids = stored(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), f"{label}-ids")
    sets = stored(_sets_of(docs, reps.select("id", "at.doc_id", "at.th"), ids, words), f"{label}-sets")
    pairs = edges.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return stored(pairs.select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a binary, b binary"), f"{label}-links")


def _labelled(docs: DataFrame, words: int, percent: int, band_rows: int, block: int) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, component (a digest, null for
    rows in no group) and component_id for each row."""
    signed = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_signed(words, band_rows, percent), SIGNED), "signatures")
    full = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    # Equal sets are one, named by their digest.
    reps = full.groupBy(F.col("digest").alias("id")).agg(F.min(F.struct("doc_id", "th")).alias("at"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "s1", "s2", "less", "odd")])
    reps = stored(reps.select("id", "at", F.col("n_shingles").alias("n"), "bands", "s1", "s2", "less", "odd"), "representatives")
    short = F.xxhash64("id").alias("short")
    # Buckets of several: key, a member, the one of least name, and how many they are.
    bucket = Window.partitionBy("key")
    hits = reps.select(short, F.explode("bands").alias("key")).select("key", "short", F.min("short").over(bucket).alias("c"), F.count(F.lit(1)).over(bucket).alias("m"))
    hits = stored(hits.filter("m > 1"), "buckets")
    ends = reps.select(short, "id", "n", "s1", "s2")
    star = hits.filter("short <> c").select("c", "short").distinct().join(ends, "short").join(ends.toDF("c", "a", "an", "a1", "a2"), "c")
    near = plausible(F.col("s1"), F.col("s2"), F.col("n"), F.col("a1"), F.col("a2"), F.col("an"), percent)
    edges = stored(star.filter(near).select("a", F.col("id").alias("b")), "candidates")
    by_one = reps.select(F.col("id").alias("b"), F.explode("less").alias("a")).join(reps.select(F.col("id").alias("a")), "a").select("a", "b")
    links = stored(_linked(docs, reps, edges, words, percent, "star").unionByName(by_one), "links")
    found = components(links)
    # Buckets whose members are not all in one component.
    placed = stored(reps.select("id", short).join(found, "id", "left").select("short", "id", F.coalesce("component", "id").alias("comp")), "placed")
    by_key = hits.select("key", "short", "m").join(placed, "short").select("key", "m", "id", "comp", F.min("comp").over(bucket).alias("lo"), F.max("comp").over(bucket).alias("hi"))
    members = by_key.filter("lo <> hi").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    # Deal a bucket's members to blocks, and blocks to pairs of blocks.
    members = members.withColumn("side", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "comp")
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda rows: rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    judged = members.join(reps.select("id", "n", "s1", "s2", "odd"), "id").select(*members.columns, "n", "s1", "s2", "odd")
    members = stored(dealt(judged).mapInArrow(_worth(percent), "key bigint, i int, j int, side int, id binary, comp binary"), "members")
    left = reps.join(_few(stored(members.select("id").distinct(), "member-ids")), "id", "left_semi")
    # Any set that the sketch does not judge with one of its partners.
    small = stored(left.filter(F.col("n") * percent < 100 * SKETCH_LEAST).select("id"), "small-ids")
    sets = _sets_of(docs, reps.select("id", "at.doc_id", "at.th"), small, words)
    at = members.join(left.select("id", "n", "s1", "s2", "bands"), "id").withColumn("band", F.array_position("bands", F.col("key")).cast("int") - 1)
    rows = at.filter("band >= 0").join(sets, "id", "left").select("key", "i", "j", "side", "id", "comp", "n", "s1", "s2", "bands", "band", "shingles")
    more = stored(dealt(rows).mapInArrow(_in_blocks(percent), "a binary, b binary, sure boolean"), "more")
    if not more.isEmpty():
        likely = stored(more.filter("NOT sure").select("a", "b").distinct(), "more-candidates")
        more = more.filter("sure").select("a", "b")
        if not likely.isEmpty():
            more = stored(more.unionByName(_linked(docs, reps, likely, words, percent, "more")), "more-links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
    grouped_ = reps.select("id", "at.doc_id").join(found, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = grouped_.groupBy("component").agg(F.min("doc_id").alias("least"))
    names = grouped_.join(least, "component").select(F.col("id").alias("digest"), "component", "least")
    joined = signed.drop("less").join(names, "digest", "left")
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "th", "n_shingles", F.when(known, F.col("component")).alias("component"), F.when(known, F.coalesce("least", "doc_id")).alias("component_id"))


def grouped(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    out = _labelled(docs, words, percent, band_rows, block).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """The documents that are kept: one of each group."""
    label = _labelled(docs, words, percent, band_rows, block).filter("doc_id = component_id")
    # Which text of a doc_id stays, without the texts; one in no group stands for itself.
    stays = label.groupBy("doc_id", F.coalesce("component", F.encode(F.col("th").cast("string"), "UTF-8")).alias("c")).agg(F.min("th").alias("_th"))
    stays = stays.select(F.col("doc_id").alias("_id"), "_th")
    known = docs.filter("doc_id IS NOT NULL").withColumn("_row", F.xxhash64("text"))
    left = known.join(stays, (known["doc_id"] == stays["_id"]) & (known["_row"] == stays["_th"]), "left_semi")
    return left.dropDuplicates(["doc_id", "_row"]).select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def query(spark, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir), words=2)
