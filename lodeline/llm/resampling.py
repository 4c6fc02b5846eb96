"""Importance resampling towards a target: documents are drawn by how much more
often their word features occur in the target's texts than in all documents.

Texts are lower-cased in ASCII and cut by the tokenizers library's untrained
``Split`` pre-tokeniser, which gives each word's offsets. Windows are pairs of
offsets: the CRC of one, two or three words joined by blanks follows from the
words' own, so no window's text is ever made. What stands between two blanks is
handed to the pre-tokeniser once for as long as a task remembers it. A pass counts features by CRC
bucket, in each task first; a second one sums the buckets' gains by document.
The draw is a shift of each score by a hash of the document's id; ranks come from
one sort over ranges of scores, whose counts alone reach the driver.

Defined results: a null or empty text, or one without words, has no features and
weight 0. A null doc_id has no hash: its score is null, and it is not drawn. Rows
with one doc_id and different texts are documents of their own; equal rows have
consecutive ranks. Very long texts are cut into pieces between words, and windows
across the cuts are counted. An empty table gives none, an empty target leaves
all its counts at 0. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import crc
from .common import documents, row_key, slices, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Words in the longest window; words that a drawn document has at least; percent drawn; what ids are hashed with.
WINDOW, LEAST_WORDS, PERCENT, SEED = 3, 20, 5, 42
#: Characters of a piece of a long text; bytes of short texts that are worked on together; characters that a task remembers.
PIECE, SLICE, REMEMBERED = 1 << 20, 1 << 23, 1 << 23
#: Rows of a task when ranks are given.
RANKED = 4_000_000


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in lower case in pieces of about ``size`` characters that end between words."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end


class Words:
    """The words of strings, as a memory of what the pre-tokeniser found in each:
    their CRCs, sizes in bytes, and the bytes of the long ones."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.chars = 0
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.crcs, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.long: dict[int, bytes] = {}

    def learn(self, units: list[str]) -> None:
        """Cuts strings into words; in the line that they are laid in, offsets tell
        whose a word is."""
        line = "\n".join(units)
        pairs = np.fromiter(chain.from_iterable(x[1] for x in _splitter().pre_tokenize_str(line)), np.int64).reshape(-1, 2)
        ends = np.cumsum([len(u) + 1 for u in units])
        count = np.bincount(np.searchsorted(ends, pairs[:, 0], "right"), minlength=len(units))
        buf = np.frombuffer(line.encode(), np.uint8)
        if len(line) != len(buf):  # offsets count characters
            pairs = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))[pairs]
        start, size = pairs[:, 0], pairs[:, 1] - pairs[:, 0]
        for i in np.flatnonzero(size > crc.SHORT).tolist():
            self.long[len(self.crcs) + i] = buf[start[i] : start[i] + size[i]].tobytes()
        self.first = np.append(self.first, len(self.crcs) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.crcs, self.sizes = np.append(self.crcs, crc.of_spans(buf, start, size)), np.append(self.sizes, size)
        known = len(self.ids)
        self.ids.update(zip(units, range(known, known + len(units))))
        self.chars += len(line)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts as places in the memory, and each one's text. A blank
        ends a word, so what stands between two is cut alone, and only once."""
        if self.chars > REMEMBERED:
            self.clear()
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        units = coded.dictionary.to_pylist()
        ids = np.array([self.ids.get(u, -1) for u in units], np.int64)
        new = np.flatnonzero(ids < 0)
        if len(new):
            ids[new] = np.arange(len(self.ids), len(self.ids) + len(new))
            self.learn([units[i] for i in new.tolist()])
        which = ids[coded.indices.to_numpy()]
        many = self.count[which]
        shift = np.repeat(self.first[which] - (np.cumsum(many) - many), many)
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
        return shift + np.arange(len(shift)), np.repeat(text, many)


_BLANK = np.array([0x20], np.uint8)
_ONE = np.ones(1, np.int64)


def _with_blank(crcs: np.ndarray) -> np.ndarray:
    return crc.joined(crcs, crc.of_spans(_BLANK, _ONE - 1, _ONE), np.ones(len(crcs), np.int64), lambda i: b" ")


NONE = [np.zeros(0, np.uint32)] * WINDOW


def features(memory: Words, words: np.ndarray, document: np.ndarray, before: list[np.ndarray] = NONE) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """For each window size the (bucket, document) of all windows that end in a
    piece; and the CRCs of the last windows, with a blank, for the next piece of the
    same document. ``before`` has those of the piece before: the k-th array is a
    window of k + 1 words that ends the first document's earlier part, if any."""
    if not len(words):
        return [], before
    out, tails, own, sizes = [], [], memory.crcs[words], memory.sizes[words]
    goes_on = np.append(True, document[1:] == document[:-1])
    long = lambda i: memory.long[int(words[i])]
    # Windows of k words that end at each word; where a document has fewer, none.
    ends, whole = own, np.ones(len(own), bool)
    for k in range(WINDOW):
        out.append((ends[whole] % BUCKETS, document[whole]))
        blanked = _with_blank(ends)
        tails.append(blanked[-1:] if whole[-1] else np.zeros(0, np.uint32))
        if k < WINDOW - 1:
            # A window of k + 1 words is the one of k words that ends a word earlier, a blank, and the word.
            previous = np.append(before[k] if len(before[k]) else np.zeros(1, np.uint32), blanked[:-1])
            whole = np.append(len(before[k]) > 0, whole[:-1]) & goes_on
            ends = crc.joined(previous, own, sizes, long)
    return out, tails


def counted(texts: pa.Array, memory: Words) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(bucket, document, whether windows are single words) of all features of
    texts, in parts; documents are places in the array."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    small = pc.less_equal(pc.binary_length(low), PIECE)
    # Long ones are left empty here.
    found, _ = features(memory, *memory.of(pc.if_else(small, low, "")))
    for k, (bucket, document) in enumerate(found):
        yield bucket, document, k == 0
    for i in np.flatnonzero(~small.to_numpy(zero_copy_only=False)).tolist():
        tails = NONE
        for piece in pieces(low[i].as_py()):
            words, document = memory.of(pa.array([piece], low.type))
            found, tails = features(memory, words, document + i, tails)
            for k, (bucket, document) in enumerate(found):
                yield bucket, document, k == 0


def _histogram(batches):
    total, memory = np.zeros(BUCKETS, np.int64), Words()
    for batch in batches:
        for part in slices([batch], "text", SLICE):
            for bucket, _, _ in counted(part.column("text"), memory):
                total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def histogram(texts: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""
    parts = texts.select("text").mapInArrow(_histogram, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """What a feature in each bucket adds to a document's weight. The driver gathers
    two histograms, each of ``BUCKETS`` rows at most."""
    def numbers(texts: DataFrame) -> list[int]:
        out = [0] * BUCKETS
        for r in histogram(texts).collect():
            out[r.bucket] = r.n
        return out

    s, t = numbers(docs), numbers(target)
    all_s, all_t = float(sum(s) + BUCKETS), float(sum(t) + BUCKETS)
    return np.array([math.floor(1000 * math.log((a + 1.0) * all_s / ((b + 1.0) * all_t))) for a, b in zip(t, s)], np.int64)


def _weighed(gain: np.ndarray):
    def run(batches):
        memory = Words()
        for batch in batches:
            for part in slices([batch], "text", SLICE):
                n = part.num_rows
                words, many, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for bucket, document, single in counted(part.column("text"), memory):
                    count = np.bincount(document, minlength=n)
                    many += count
                    words += count if single else 0
                    weight += np.bincount(document, weights=gain[bucket], minlength=n).astype(np.int64)  # whole numbers below 2^53
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words), pa.array(many), pa.array(weight)], names=["doc_id", "rk", "n_words", "n_features", "weight"])

    return run


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, rk, n_words, n_features and weight of every row."""
    return docs.select("doc_id", row_key(F.col("text"), F.col("doc_id")).alias("rk"), "text").mapInArrow(_weighed(gain), "doc_id bigint, rk bigint, n_words bigint, n_features bigint, weight bigint")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of
    ``docs`` (doc_id, text); ``target``: text. The ``percent`` of documents with
    words enough that score highest have ranks, from 1 on."""
    rows = weighed(docs, gains(docs, target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stored(rows.withColumn("score", score.cast("long")).withColumn("first", (F.col("n_words") >= LEAST_WORDS) & F.col("score").isNotNull()), "scored")
    many = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("first").cast("long")), F.lit(0)).alias("able")).first()
    drawn = percent * many["able"] // 100
    order = [F.desc("first"), F.desc("score"), F.asc("doc_id"), F.asc("rk")]
    tasks = max(8, -(-many["n"] // RANKED))
    ranged = stored(rows.repartitionByRange(tasks, *order).withColumn("range", F.spark_partition_id()), "ranged")
    # One row for each range: what comes before it.
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    before, so_far = [], 0
    for i in range(max(sizes, default=0) + 1):  # Spark may have made more than asked for
        before.append(so_far)
        so_far += sizes.get(i, 0)
    offset = F.element_at(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("range") + 1)
    place = offset + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    out = ranged.withColumn("place", place)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("first") & (F.col("place") <= drawn), F.col("place")).cast("long").alias("rank"))


def query(spark, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = lambda name, table, key: f"""{name}_w AS (SELECT {key} AS id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT {key}, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})),
{name}_g AS (SELECT id, i, unnest([w, w || ' ' || lead(w, 1) OVER o, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o]) AS g FROM {name}_w WINDOW o AS (PARTITION BY id ORDER BY i)),
{name}_f AS (SELECT id, g, count(*) AS n FROM {name}_g WHERE g IS NOT NULL GROUP BY ALL)"""  # noqa: E731
ORACLE_SQL = f"""WITH {crc.TABLE_SQL},
{_WORDS('d', 'documents', 'doc_id')},
{_WORDS('b', 'benchmark', 'item_id')},
v AS (SELECT DISTINCT g FROM (SELECT g FROM d_f UNION ALL SELECT g FROM b_f)),
k AS (SELECT g, {crc.sql('g')} % {BUCKETS} AS bucket FROM v, crc_t),
s AS (SELECT bucket, sum(n) AS s FROM d_f JOIN k USING (g) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM b_f JOIN k USING (g) GROUP BY 1),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + {BUCKETS} AS all_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + {BUCKETS} AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * all_s / ((s + 1.0::DOUBLE) * all_t)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
w AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM d_f JOIN k USING (g) JOIN gain USING (bucket) GROUP BY 1),
c AS (SELECT id, count(*) AS n_words FROM d_w GROUP BY 1),
x AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w ON w.id = doc_id LEFT JOIN c ON c.id = doc_id),
y AS (SELECT * EXCLUDE h, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= {LEAST_WORDS})
SELECT y.*, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)"""
