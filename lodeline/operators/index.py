"""An inverted index of passages, and BM25 over it.

Passages are indexed in segments, each made in one task: for every term, blocks of
up to ``BLOCK`` passages with their ids (as gaps), sizes, hits and places. A segment's
rows stand in the order of their terms, and terms are written front-coded, so that a
prefix is one range of a file, found by its pages' bounds. Indexing more passages adds
segments and touches no others; the empty term lists a segment's passages.

A search asks for phrases, whose last token is a prefix. The blocks of asked terms meet
by segment: there a single token's hits are summed over its range of terms, and a longer
phrase's places are intersected. Once it is known how many passages each phrase has
anywhere, segments are scored, several in a task one after the other, so that each
question's best of the earlier ones bound the later. For a few questions, ranges of
passages whose best possible score is below that bound are skipped. Many questions are
scored together: rare phrases' hits are added up, and frequent phrases, which few passages
still need, only where the sum can reach the bound with them. Phrases are worked on in
rounds of a bounded number of questions, which go to every task.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import Least, marked
from .staging import stored

#: A hit in a heading counts 0.6: hits are added up in fifths, as whole numbers.
K1, B, IN_TEXT, IN_HEADING = 1.2, 0.75, 5, 3
#: Passages in a block of a term; tokens in a segment; passages in a range that is skipped as a whole.
BLOCK, SEGMENT, RANGE = 128, 2_000_000, 256
#: Tokens of a segment that is asked as it is made, and so is held with all its hits.
ASKED = 1_250_000
#: Sums of hits that are held at once while a segment's are added up.
CELLS = 2_000_000
#: Questions of a round; distinct tokens up to which the files' reader is told them, and up to which blocks are ruled out before they meet.
ROUND, PUSHED, RULED = 100_000, 48, 10_000
#: Questions up to which each is scored by itself; a phrase with this part of a segment's passages, or more, is frequent; segments of a task at most.
ALONE, FREQUENT, SEGMENTS = 64, 32, 64
#: Of scores that are added up coarsely: a step, what is too little for one, and steps at most.
STEP, TINY, STEPS = 0.01, 1e-4, 65_000
#: Scores are rounded to this; what is within it of a limit is kept.
SLACK = 2e-6

INDEX = "term string, segment string, ids array<bigint>, sizes array<int>, in_text array<int>, in_heading array<int>, places array<int>"
_INDEX = pa.schema([("term", pa.string()), ("segment", pa.string()), ("ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("sizes", "in_text", "in_heading", "places")]])


# ---- building ---------------------------------------------------------------

def _cut(values: np.ndarray, starts: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, type_))


def gaps(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each block's first id, then differences."""
    out = np.diff(ids, prepend=ids[:1])
    out[starts] = ids[starts]
    return out


def ids_of(gaps_: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids again; sums may wrap, and come out right."""
    if not len(gaps_):
        return gaps_
    sums = np.cumsum(gaps_)
    before = np.where(starts > 0, sums[starts - 1], 0)
    return sums - np.repeat(before, np.diff(np.append(starts, len(gaps_))))


def segment(ids: np.ndarray, texts: pa.ListArray, headings: pa.ListArray) -> pa.RecordBatch:
    """One segment's rows, of passages and their tokens."""
    order = np.argsort(ids, kind="stable")
    ids, texts, headings = ids[order], texts.take(pa.array(order)), headings.take(pa.array(order))
    n = len(ids)
    many = [pc.list_value_length(x).to_numpy() for x in (texts, headings)]
    tokens = pa.concat_arrays([texts.flatten(), headings.flatten()]).dictionary_encode()
    terms = tokens.dictionary
    rank = np.empty(len(terms), np.int64)
    by_term = pc.sort_indices(terms).to_numpy()
    rank[by_term] = np.arange(len(terms))
    passage = np.concatenate([np.repeat(np.arange(n), m) for m in many])
    # A place is twice the token's number, and one more in a heading.
    place = np.concatenate([2 * (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)) + k for k, m in enumerate(many)]).astype(np.int32)
    coded = rank[tokens.indices.to_numpy()] if len(tokens) else np.zeros(0, np.int64)
    turn = np.argsort(coded * n + passage, kind="stable").astype(np.int32)
    coded, passage, place = coded[turn], passage[turn], place[turn]
    del turn, tokens
    first = np.flatnonzero(np.append(True, (coded[1:] != coded[:-1]) | (passage[1:] != passage[:-1]))) if len(coded) else np.zeros(0, np.int64)
    term, here = coded[first], passage[first]
    headed = np.add.reduceat(place & 1, first) if len(first) else np.zeros(0, np.int64)
    hits = np.diff(np.append(first, len(coded)))
    # Before all terms the empty one, which every passage has, without places.
    term, here = np.append(np.full(n, -1), term), np.append(np.arange(n), here)
    hits, headed = np.append(np.zeros(n, np.int64), hits), np.append(np.zeros(n, np.int64), headed)
    begins = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    inside = np.arange(len(term)) - np.repeat(begins, np.diff(np.append(begins, len(term))))
    block = np.flatnonzero(inside % BLOCK == 0)
    at = np.append(0, np.cumsum(hits))[block]
    names = pa.concat_arrays([pa.array([""]), terms.take(pa.array(by_term)).cast(pa.string())]).take(pa.array(term[block] + 1))
    columns = [gaps(ids[here], block), (many[0] + many[1])[here], hits - headed, headed]
    lists = [_cut(c, block, t.type.value_type) for c, t in zip(columns, list(_INDEX)[2:6])]
    label = pa.array([uuid.uuid4().hex] * len(block))
    return pa.RecordBatch.from_arrays([names, label, *lists, _cut(place, at, pa.int32())], schema=_INDEX)


#: Every byte as a token of plain letters and numbers has it; others are 0.
_PLAIN = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], np.uint8)


def runs(texts: pa.Array) -> pa.ListArray:
    """Texts' runs of plain letters and numbers, in lower case; other bytes part them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = _PLAIN[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if data else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = held != 0
    begins = np.append(inside[:1], inside[1:] & ~inside[:-1])
    begins[bounds[:-1][bounds[:-1] < len(held)]] = True  # a text's first byte ends the text before it
    begins &= inside
    first = np.flatnonzero(begins)
    full = np.append(0, np.cumsum(inside, dtype=np.int64))
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(full[first], full[-1]).astype(np.int32)), pa.py_buffer(held[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, bounds), pa.int32()), words)


def bare(texts: pa.Array) -> pa.Array:
    """Without marks on letters."""
    return pc.utf8_normalize(pc.replace_substring_regex(pc.utf8_normalize(texts, "NFD"), r"[\x{0300}-\x{036F}]", ""), "NFC")


def tokens(texts: pa.Array) -> pa.ListArray:
    """The index tokens of texts, as ``T.tokens`` gives them, by Arrow's own
    functions; plain texts are cut by their bytes."""
    texts = pc.fill_null(texts, "")
    plain = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
    if plain.all():
        return runs(texts)
    stripped = bare(texts.filter(pa.array(~plain)))
    now = pc.string_is_ascii(stripped).to_numpy(zero_copy_only=False)
    lowered = pc.utf8_lower(stripped.filter(pa.array(~now)))
    parts = pc.split_pattern_regex(lowered, r"[^\p{L}\p{N}]+")
    words = parts.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    many = np.add.reduceat(np.append(full, False), (parts.offsets.to_numpy() - parts.offsets[0].as_py())[:-1], dtype=np.int64) if len(parts) else np.zeros(0, np.int64)
    other = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), words.filter(pa.array(full)))
    marked = np.flatnonzero(~plain)
    order = np.concatenate([np.flatnonzero(plain), marked[now], marked[~now]])
    return pa.concat_arrays([runs(texts.filter(pa.array(plain))), runs(stripped.filter(pa.array(now))), other]).take(pa.array(np.argsort(order)))


def _whole_segments(batches, most: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def made():
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, texts, headings = (whole.column(c).combine_chunks() for c in range(3))
        return segment(ids.to_numpy(), texts, headings)

    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            part = pa.RecordBatch.from_arrays([part.column(0), tokens(part.column(1)), tokens(part.column(2))], names=["id", "text", "heading"])
            held.append(part)
            size += len(part.column(1).flatten()) + len(part.column(2).flatten())
            if size >= most:
                out, held, size = made(), [], 0
                yield out
                del out
    if held:
        yield made()


def _segments(batches) -> Iterator[pa.RecordBatch]:
    for out in _whole_segments(batches, SEGMENT):
        for k in range(0, out.num_rows, 10_000):
            yield out.slice(k, 10_000)


def by_bucket(batches) -> Iterator[pa.RecordBatch]:
    """Segments of passages (chunk_id, text, heading, bucket) in the order of
    buckets; no segment has passages of two."""
    def parts():
        for batch in batches:
            bucket = batch.column(3).to_numpy()
            seams = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
            for a, b in zip(seams, seams[1:]):
                if b > a:
                    yield int(bucket[a]), batch.slice(a, b - a)

    for bucket, some in groupby(parts(), lambda x: x[0]):
        for made in _segments(x for _, x in some):
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array([bucket] * made.num_rows, pa.int32())], names=[*_INDEX.names, "bucket"])


def indexed(passages: DataFrame) -> DataFrame:
    """The index of passages (chunk_id, text, heading), a null text or heading
    being empty: rows that are to be written by ``write_options``."""
    return passages.select("chunk_id", "text", "heading").mapInArrow(_segments, INDEX)


#: How an index is written: terms in order, front-coded.
WRITING = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}


# ---- asking -----------------------------------------------------------------

def phrases(questions: DataFrame) -> DataFrame:
    """(question_id, phrase) of questions (question_id, question)."""
    return questions.select("question_id", F.explode(T.query_terms(F.col("question"))).alias("phrase"))


class Asked:
    """A round's distinct phrases as lists of tokens, by number. The last token
    of each is a prefix."""

    def __init__(self, tokens: list[list[str]]):
        self.tokens = tokens
        self.whole = pa.array(sorted({t for x in tokens for t in x[:-1]}), pa.string())
        lasts = {x[-1] for x in tokens}
        self.prefixes = {n: pa.array(sorted(t for t in lasts if len(t) == n), pa.string()) for n in {len(t) for t in lasts}}
        ones: dict[int, list] = {}
        for k, x in enumerate(tokens):
            if len(x) == 1:
                ones.setdefault(len(x[0]), []).append((x[0], k))
        #: Phrases of one token by its length: the tokens, and their numbers.
        self.ones = {n: (pa.array([t for t, _ in some], pa.string()), np.array([k for _, k in some], np.int64)) for n, some in ones.items()}
        self.longer = [k for k, x in enumerate(tokens) if len(x) > 1]
        self.placed = bool(self.longer)

    def wants(self, terms: pa.Array) -> pa.Array:
        """Which of the terms are asked for, or are the empty one."""
        out = pc.or_(pc.equal(terms, ""), pc.is_in(terms, value_set=self.whole))
        for n, some in self.prefixes.items():
            out = pc.or_(out, pc.is_in(pc.utf8_slice_codeunits(terms, 0, n), value_set=some))
        return out

    def pushed(self, index: DataFrame) -> DataFrame:
        """The index's rows as far as the files' own bounds tell what is asked."""
        heads = {t for x in self.tokens for t in x}
        if len(heads) > PUSHED:
            return index
        wanted = F.col("term") == ""
        for t in sorted(heads):
            wanted = wanted | F.col("term").startswith(t)
        return index.filter(wanted)


def _wanted(asked: Asked):
    def run(batches):
        for batch in batches:
            out = batch.filter(asked.wants(batch.column(0)))
            if out.num_rows:
                yield out

    return run


class Segment:
    """A segment's asked blocks: its passages, and every term's hits."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows, [("term", "ascending")])).combine_chunks()
        lists = lambda c: rows[c].combine_chunks() if rows[c].num_chunks else pa.array([], rows[c].type)
        # Blocks of one term may come in any order: each is decoded by itself.
        flat = {c: lists(c).flatten().to_numpy() for c in ("ids", "sizes", "in_text", "in_heading")}
        lengths = pc.list_value_length(lists("ids")).to_numpy()
        starts = np.cumsum(lengths) - lengths
        ids = ids_of(flat["ids"], starts)
        terms = lists("term")
        ends = np.append(starts, len(ids))
        n = int(ends[pc.sum(pc.equal(terms, "")).as_py() or 0])  # what the empty term has comes first
        order = np.argsort(ids[:n], kind="stable")
        self.ids, self.sizes = ids[:n][order], flat["sizes"][:n][order]
        self.term, self.ends, self._terms = terms, ends, None
        self.passage = np.searchsorted(self.ids, ids).astype(np.int32)
        self.weight = IN_TEXT * flat["in_text"] + IN_HEADING * flat["in_heading"]
        if "places" in rows.column_names:
            self.places = lists("places").flatten().to_numpy().astype(np.int64)
            self.placed = np.append(0, np.cumsum(flat["in_text"] + flat["in_heading"]))

    @property
    def terms(self) -> list[str]:
        if self._terms is None:
            self._terms = self.term.to_pylist()
        return self._terms

    def range(self, token: str, prefix: bool) -> tuple[int, int]:
        """The hits of a term, or of all terms that begin so: one range."""
        lo = bisect_left(self.terms, token)
        hi = bisect_left(self.terms, token + ("\U0010ffff" if prefix else "\0"), lo)
        return int(self.ends[lo]), int(self.ends[hi])

    def ranges(self, ones: dict[int, tuple[pa.Array, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of many prefixes at once, by their lengths: those that some
        term has, as (number, start, end)."""
        out = [(np.zeros(0, np.int64),) * 3]
        lengths = pc.utf8_length(self.term).to_numpy()
        for n, (tokens_, numbers) in ones.items():
            long = np.flatnonzero(lengths >= n)
            code = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(self.term.take(pa.array(long)), 0, n), value_set=tokens_), -1).to_numpy()
            long, code = long[code >= 0], code[code >= 0]
            # Terms that begin alike stand together.
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(code)) - 1 if len(first) else first
            out.append((numbers[code[first]], self.ends[long[first]], self.ends[long[last] + 1]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def spots(self, a: int, b: int, shift: int) -> np.ndarray:
        """Where in which passage a phrase would begin whose token ``shift`` is
        one of these hits; in order, once each."""
        passage = np.repeat(self.passage[a:b].astype(np.int64), np.diff(self.placed[a : b + 1]))
        return np.unique((passage << 32) + self.places[self.placed[a] : self.placed[b]] + (1 << 31) - 2 * shift)

    def phrase(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Passages of a phrase of several tokens and its weighted hits in each:
        their places are intersected."""
        spots = None
        for i, t in enumerate(tokens):
            more = self.spots(*self.range(t, i == len(tokens) - 1), i)
            spots = more if spots is None else np.intersect1d(spots, more, assume_unique=True)
            if not len(spots):
                break
        f = np.bincount(spots >> 32, weights=np.where(spots & 1, IN_HEADING, IN_TEXT), minlength=len(self.ids))
        found = np.flatnonzero(f)
        return found, f[found]

    def singles(self, ones: dict[int, tuple[pa.Array, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of phrases of one token, many at once: (phrase, passage,
        weighted hits); each phrase's hits together, in the order of passages."""
        n = len(self.ids)
        number, start, end = self.ranges(ones)
        size = end - start
        out = [(np.zeros(0, np.int32),) * 3]
        # Prefixes of many hits have a cell for each passage; the hits of others are sorted.
        for some, cells in ((np.flatnonzero(size * 8 >= n), n), (np.flatnonzero(size * 8 < n), 0)):
            room = np.cumsum(size[some] + cells) // (CELLS // 2)
            for part in np.split(some, np.flatnonzero(np.diff(room)) + 1) if len(some) else []:
                s = size[part]
                at = np.repeat(start[part] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                key = np.repeat(np.arange(len(part)) * n, s) + self.passage[at]
                if cells:
                    f = np.bincount(key, weights=self.weight[at])
                    found = np.flatnonzero(f)
                    f = f[found]
                else:
                    order = np.argsort(key)
                    key = key[order]
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    found, f = key[first], np.add.reduceat(self.weight[at[order]], first)
                out.append(tuple(x.astype(np.int32) for x in (number[part[found // n]], found % n, f)))
        return tuple(np.concatenate(x) for x in zip(*out))


#: The row of phrase -1 has a segment's passages, their ids and sizes, and the sum of these. Lists are 64 bits a number for ids, else 32.
HITS = "segment string, phrase int, n bigint, tokens bigint, passages binary, hits binary, ids binary, sizes binary, kth double"
_HITS = pa.schema([("segment", pa.string()), ("phrase", pa.int32()), ("n", pa.int64()), ("tokens", pa.int64()), *[(c, pa.binary()) for c in ("passages", "hits", "ids", "sizes")], ("kth", pa.float64())])
#: How hits are written.
PACKED = {"parquet.enable.dictionary": "false", "compression": "lz4"}


def _packed(values: np.ndarray, starts: np.ndarray, kind: type) -> pa.Array:
    """Lists as their bytes, lists that begin at ``starts``."""
    width = np.dtype(kind).itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(values)) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, kind))])


def _unpacked(lists: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All their numbers, and how many each list has."""
    _, offsets, data = lists.buffers()
    bounds = np.frombuffer(offsets, np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, kind)[bounds[0] // width : bounds[-1] // width] if data else np.zeros(0, kind), np.diff(bounds) // width


def _part(hits: np.ndarray, sizes: np.ndarray, average: float) -> np.ndarray:
    f = hits / IN_TEXT
    return f * (K1 + 1) / (f + K1 * (1 - B + B * sizes / average))


def _hits(asked: Asked, average: float | None, top: int):
    """Without an average size, nothing is told of a phrase's best parts."""
    def run(rows: pa.Table) -> pa.Table:
        label = rows["segment"][0].as_py()
        here = Segment(rows)
        found = [here.singles(asked.ones)]
        for k in asked.longer:
            passage, f = here.phrase(asked.tokens[k])
            found.append(tuple(x.astype(np.int32) for x in (np.full(len(passage), k), passage, f)))
        owner, passage, f = (np.concatenate(x) for x in zip(*found))
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        n = np.diff(np.append(starts, len(owner)))
        kth = np.zeros(len(starts))
        if average:
            part = _part(f, here.sizes[passage], average)
            for i in np.flatnonzero(n >= top).tolist():
                kth[i] = np.partition(part[starts[i] : starts[i] + n[i]], n[i] - top)[n[i] - top]
        # The passages' row comes first; it has what the others do not have.
        own = np.append(0, np.full(len(starts), len(here.ids)))
        lists = [_packed(passage, np.append(0, starts), np.int32), _packed(f, np.append(0, starts), np.int32), _packed(here.ids, own, np.int64), _packed(here.sizes, own, np.int32)]
        numbers = [np.append(-1, owner[starts]).astype(np.int32), np.append(len(here.ids), n), np.append(here.sizes.sum(dtype=np.int64), 0 * n)]
        return pa.table([pa.array([label] * len(own), pa.string()), *map(pa.array, numbers), *lists, pa.array(np.append(0.0, kth))], schema=_HITS)

    return run


def _hits_of_texts(asked: Asked):
    """Hits without a stored index: segments are made and asked in one task."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        asks = _hits(asked, None, 0)
        for made in _whole_segments(batches, ASKED):
            for batch in asks(pa.Table.from_batches([made])).to_batches():
                for k in range(0, batch.num_rows, 10_000):
                    yield batch.slice(k, 10_000)
            pa.default_memory_pool().release_unused()  # the worker lives on

    return run


SCORED = "question_id bigint, chunk_id bigint, total double"
_SCORED = pa.schema([("question_id", pa.int64()), ("chunk_id", pa.int64()), ("total", pa.float64())])


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of several ranges."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Questions:
    """Questions' ids and phrases, one question's after the other's."""

    def __init__(self, ids: np.ndarray, phrases_: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, first = np.unique(ids[order], return_index=True)
        self.phrases = phrases_[order].astype(np.int32)
        self.starts = np.append(first, len(order))
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))


class Found:
    """The best ``top`` passages seen so far of each of ``questions``; ties of
    rounded scores go to the lesser id. ``limit``: what a question's passages
    must reach; at first, what its ``top``-th passage of some phrase has."""

    def __init__(self, questions: Questions, limits: np.ndarray, top: int):
        self.questions, self.top = questions, top
        self.limit = np.maximum.reduceat(limits[questions.phrases], questions.starts[:-1])
        self.best = Least(len(questions.ids), top)

    def add(self, question: np.ndarray, ids: np.ndarray, totals: np.ndarray) -> None:
        self.best.add(question, ids, -totals)
        self.limit[question] = np.maximum(self.limit[question], -self.best.values[question, -1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for question, ids, values in self.best.rows():
            yield pa.RecordBatch.from_arrays([pa.array(self.questions.ids[question]), pa.array(ids), pa.array(-values)], schema=_SCORED)


class Scorer:
    """The best passages of a segment for each question. ``idf``: by phrase;
    ``limits``: by phrase, what its ``top``-th best passage has somewhere.
    ``skipped`` and ``seen`` count ranges of passages."""

    def __init__(self, rows: pa.Table, idf: np.ndarray, limits: np.ndarray, top: int, average: float | None = None):
        self.limits, self.top, self.skipped, self.seen, self._ranged = idf * limits, top, 0, 0, False
        phrase = rows["phrase"].to_numpy()
        # The row of passages, wherever it stands, has no hits.
        (self.passage, self.size), (hits, _), (self.ids, _), (sizes, _) = (_unpacked(rows[c].combine_chunks(), k) for c, k in (("passages", np.int32), ("hits", np.int32), ("ids", np.int64), ("sizes", np.int32)))
        self.start = np.cumsum(self.size) - self.size
        self.n = len(self.ids)
        self.part = _part(hits, sizes[self.passage], average or float(sizes.mean()) or 1.0) * np.repeat(idf[phrase], self.size)
        self.row = np.full(len(idf), -1)
        self.row[phrase[phrase >= 0]] = np.flatnonzero(phrase >= 0)

    def _range(self) -> None:
        # A phrase's hits are in the order of passages: each range of these is a run, and has a maximum.
        self.ranges, self._ranged = max(1, -(-self.n // RANGE)), True
        cell = np.repeat(np.arange(len(self.size)), self.size) * self.ranges + self.passage // RANGE
        self.ends = np.searchsorted(cell, np.arange(len(self.size) * self.ranges + 1))
        self.most = np.zeros(len(self.size) * self.ranges)
        full = np.flatnonzero(np.diff(self.ends))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.part, self.ends[full])
        self.most = self.most.reshape(-1, self.ranges)

    def _sums(self, rows: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """All passages' sums of some phrases' parts in some ranges."""
        cells = (rows[:, None] * self.ranges + ranges[None, :]).ravel()
        at = _spread(self.ends[cells], self.ends[cells + 1] - self.ends[cells])
        return np.bincount(self.passage[at], weights=self.part[at], minlength=self.n)

    def best(self, phrases_: np.ndarray, whole: bool = False, limit: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Passages and scores that may be among the best ``top`` of all, and
        reach a limit; ``whole``: no range is skipped."""
        rows = self.row[phrases_]
        rows = rows[rows >= 0]
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0)
        if not self._ranged:
            self._range()
        limit = 0.0 if whole else max(limit, float(self.limits[phrases_].max()))
        bounds = self.most[rows].sum(axis=0)
        order = np.argsort(-bounds, kind="stable")
        total, done = np.zeros(self.n), 0
        self.seen += len(order)
        # The ranges that promise most come first: what they give tells which of the others can matter.
        for stop in (max(4, len(order) // 8), len(order)):
            some = order[done:stop]
            some = some[bounds[some] >= max(limit - SLACK, 0)]
            if len(some):
                total += self._sums(rows, some)
                done += len(some)
                if len(total) > self.top:
                    limit = max(limit, float(np.partition(total, len(total) - self.top)[len(total) - self.top]))
        self.skipped += len(order) - done
        keep = np.flatnonzero((total > 0) & (total >= limit - SLACK))
        return self.ids[keep], total[keep]

    def alone(self, questions: Questions, found: Found, some: np.ndarray | None = None) -> None:
        """The best passages of all or ``some`` questions, one by one, by ranges."""
        for q in range(len(questions.ids)) if some is None else some.tolist():
            ids, totals = self.best(questions.phrases[questions.starts[q] : questions.starts[q + 1]], limit=float(found.limit[q]))
            if len(ids):
                found.add(np.full(len(ids), q), ids, totals)

    def together(self, questions: Questions, found: Found) -> None:
        """All questions' best passages. Parts are first added up as whole
        steps, rounded up, which a few bits hold: what so reaches a question's
        limit is added up exactly."""
        many, n = len(questions.ids), -(-self.n // 8) * 8
        rows = self.row[questions.phrases]
        here = np.flatnonzero(rows >= 0)
        rows, owner = rows[here], questions.owner[here]
        if not len(rows):
            return
        steps = np.ceil(np.maximum(self.part - TINY, 0) / STEP)
        full = np.flatnonzero(self.size)
        most, least = np.zeros(len(self.size)), np.ones(len(self.size))
        most[full], least[full] = np.maximum.reduceat(steps, self.start[full]), np.minimum.reduceat(steps, self.start[full])
        phrases_ = np.bincount(owner, minlength=many)
        could = np.bincount(owner, weights=most[rows], minlength=many)
        slight = np.bincount(owner[least[rows] == 0], minlength=many) > 0  # some parts of these are no step
        steps = np.minimum(steps, STEPS).astype(np.uint16)
        # Frequent phrases have a cell for each passage, as many as fit.
        often = np.flatnonzero((self.size * FREQUENT >= n) & (self.size > 0))
        often = often[np.argsort(-self.size[often], kind="stable")][: 4 * CELLS // n]
        frequent = np.full(len(self.size), -1)
        frequent[often] = np.arange(len(often))
        cells, coarse = np.zeros((len(often), n)), np.zeros((len(often), n), np.uint16)
        at, line = _spread(self.start[often], self.size[often]), np.repeat(np.arange(len(often)), self.size[often])
        cells[line, self.passage[at]], coarse[line, self.passage[at]] = self.part[at], steps[at]
        oft = frequent[rows] >= 0
        rare, rare_at = rows[~oft], np.searchsorted(owner[~oft], np.arange(many + 1))
        other, other_at = frequent[rows[oft]], np.searchsorted(owner[oft], np.arange(many + 1))

        def needed(qs: np.ndarray) -> np.ndarray:
            return np.clip(np.ceil((found.limit[qs] - SLACK - phrases_[qs] * TINY) / STEP - 1e-9), 1, STEPS + 1)

        def batch(qs: np.ndarray) -> None:
            """Questions in falling order of their frequent phrases."""
            more, m = other_at[qs + 1] - other_at[qs], rare_at[qs + 1] - rare_at[qs]
            sums, line, mark = (x[: len(qs)] for x in room)
            sums[:] = 0
            for s in range(int(more[0])):
                k = int(np.count_nonzero(more > s))
                np.take(coarse, other[other_at[qs[:k]] + s], axis=0, out=line[:k], mode="clip")
                np.add(sums[:k], line[:k], out=sums[:k])
            some = rare[_spread(rare_at[qs], m)]
            size = self.size[some]
            at = _spread(self.start[some], size)
            cell = np.repeat(np.repeat(np.arange(len(qs)) * n, m), size) + self.passage[at]
            flat = sums.reshape(-1)
            np.add.at(flat, cell, steps[at])
            fresh = np.flatnonzero(needed(qs) <= 1)
            if len(fresh) and self.n > self.top:  # what the top-th of these sums is at least worth is a limit
                worth = np.partition(sums[fresh], n - self.top, axis=1)[:, n - self.top].astype(np.int64) - phrases_[qs[fresh]]
                found.limit[qs[fresh]] = np.maximum(found.limit[qs[fresh]], worth * STEP)
            # Passages of which no part is a step can matter where a limit is next to nothing.
            low = slight[qs] & (found.limit[qs] <= SLACK + (phrases_[qs] + 1) * TINY)
            later.append(qs[low])
            np.greater_equal(sums, np.where(low, STEPS + 1, needed(qs)).astype(np.uint16)[:, None], out=mark)
            pair = marked(mark)
            local, passage = np.divmod(pair, n)
            q, total = qs[local], np.zeros(len(pair))
            for s in range(int(more[0])):
                k = int(np.searchsorted(local, np.count_nonzero(more > s)))
                total[:k] += cells.reshape(-1).take(other[other_at[q[:k]] + s] * n + passage[:k])
            hit = np.flatnonzero(mark.reshape(-1)[cell])
            total += np.bincount(np.searchsorted(pair, cell[hit]), weights=self.part[at[hit]], minlength=len(pair))
            keep = np.flatnonzero((total > 0) & (total >= found.limit[q] - SLACK))
            if len(keep):
                found.add(q[keep], self.ids[passage[keep]], total[keep])

        later = [np.flatnonzero(could > STEPS)]
        live = np.flatnonzero((could <= STEPS) & ((could >= needed(np.arange(many))) | slight & (found.limit <= SLACK + (phrases_ + 1) * TINY)))
        live = live[np.argsort(other_at[live] - other_at[live + 1], kind="stable")]
        step = max(1, CELLS // 8 // n)
        room = [np.zeros((step, n), kind) for kind in (np.uint16, np.uint16, bool)]
        for k in range(0, len(live), step):
            batch(live[k : k + step])
        self.alone(questions, found, np.concatenate(later))


def _each_segment(batches) -> Iterator[pa.Table]:
    """Rows in the order of segments, a segment at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        label = batch.column(0).dictionary_encode().indices.to_numpy()
        seams = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), batch.num_rows]
        for a, b in zip(seams, seams[1:]):
            if held and b > a and held[-1].column(0)[0] != batch.column(0)[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _scores(questions: Questions, idf: np.ndarray, limits: np.ndarray, average: float, top: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        found = Found(questions, idf * limits, top)
        for rows in _each_segment(batches):
            scorer = Scorer(rows, idf, limits, top, average)
            (scorer.alone if len(questions.ids) <= ALONE else scorer.together)(questions, found)
        yield from found.rows()

    return run


def _asked(wanted: DataFrame) -> tuple[Questions, Asked]:
    """The questions and phrases of a round, phrases of the same tokens as one."""
    told = wanted.select("question_id", "phrase").toArrow()  # ROUND questions at most
    phrase = told["phrase"].combine_chunks().dictionary_encode()
    split = [tuple(t for t in re.split("[^a-z0-9]+", p) if t) for p in phrase.dictionary.to_pylist()]
    words = sorted({t for t in split if t})
    number = {t: k for k, t in enumerate(words)}
    number = np.array([number.get(t, -1) for t in split], np.int64)[phrase.indices.to_numpy()]
    return Questions(told["question_id"].to_numpy()[number >= 0], number[number >= 0]), Asked([list(t) for t in words])


def _ranked(hits: DataFrame, questions: Questions, asked: Asked, whole: dict[str, tuple[int, int]], top: int) -> DataFrame:
    """Scores of questions by stored hits; ``whole``: each segment's passages
    and tokens."""
    spark, idf, limits = hits.sparkSession, np.zeros(len(asked.tokens)), np.zeros(len(asked.tokens))
    n, total = (sum(x) for x in zip(*whole.values()))
    known = hits.filter("phrase >= 0").groupBy("phrase").agg(F.sum("n").alias("n"), F.max("kth").alias("kth")).toArrow()  # a row for each phrase of the round
    at, many = known["phrase"].to_numpy(), known["n"].to_numpy()
    raw = np.log((n - many + 0.5) / (many + 0.5))
    idf[at], limits[at] = np.where(raw > 0, raw, 1e-6), known["kth"].to_numpy()
    # Large and small segments are dealt out alike, to as many tasks as run at once.
    tasks = max(1, min(len(whole), max(spark.sparkContext.defaultParallelism, -(-len(whole) // SEGMENTS))))
    turns = spark.createDataFrame([(label, k % tasks) for k, label in enumerate(sorted(whole, key=lambda x: (-whole[x][1], x)))], "segment string, turn int")
    dealt = hits.join(F.broadcast(turns), "segment").repartitionById(tasks, F.col("turn")).select(*hits.columns).sortWithinPartitions("segment")
    return dealt.mapInArrow(_scores(questions, idf, limits, total / n or 1.0, top), SCORED)


def _round(index: DataFrame, wanted: DataFrame, top: int, whole: dict[str, tuple[int, int]]) -> DataFrame:
    """Scores of the phrases of a bounded number of questions."""
    questions, asked = _asked(wanted)
    if not asked.tokens or not whole:
        return index.sparkSession.createDataFrame([], SCORED)
    n, total = (sum(x) for x in zip(*whole.values()))
    columns = [c for c in _INDEX.names if c != "places" or asked.placed]
    schema = ", ".join(x for x in INDEX.split(", ") if x.split()[0] in columns)
    blocks = asked.pushed(index).select(*columns)
    if len(asked.tokens) <= RULED:  # more leave hardly a term out
        blocks = blocks.mapInArrow(_wanted(asked), schema)
    hits = stored(blocks.groupBy("segment").applyInArrow(_hits(asked, total / n or 1.0, top), HITS), "phrase-hits", **PACKED)
    return _ranked(hits, questions, asked, whole, top)


def _score(total: DataFrame) -> DataFrame:
    return total.select("question_id", "chunk_id", F.round(-F.col("total"), 6).alias("score"))


def scores(index: DataFrame, questions: DataFrame, top: int, per_round: int = ROUND) -> DataFrame:
    """question_id, chunk_id and score (more negative is better) of all passages
    that may be among the best ``top`` of each question, over a stored index."""
    wanted = stored(phrases(questions), "asked-phrases")
    sizes = index.filter("term = ''").select("segment", F.size("ids").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    whole = {r.segment: (r.n, r.total) for r in sizes.groupBy("segment").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}  # a row for each segment
    rounds = max(1, -(-wanted.select("question_id").distinct().count() // per_round))
    out = None
    for i in range(rounds):
        some = wanted if rounds == 1 else wanted.filter(F.pmod(F.xxhash64("question_id"), F.lit(rounds)) == i)
        part = _round(index, some, top, whole)
        part = part if rounds == 1 else stored(part, "scores")
        out = part if out is None else out.unionByName(part)
    return _score(out)


def scores_of_texts(passages: DataFrame, questions: DataFrame, top: int, per_round: int = ROUND) -> DataFrame:
    """The same for passages (chunk_id, text, heading) that have no index.
    Questions of one round need none: phrases are looked for as segments are
    made. For more, an index is stored. A large file in one piece is dealt out
    to all tasks first."""
    wanted, passages = stored(phrases(questions), "asked-phrases"), passages.select("chunk_id", "text", "heading").repartition("chunk_id")
    if wanted.select("question_id").distinct().count() > per_round:
        return scores(stored(indexed(passages), "index", **WRITING), questions, top, per_round)
    asks, asked = _asked(wanted)
    hits = stored(passages.mapInArrow(_hits_of_texts(asked), HITS), "phrase-hits", **PACKED)
    whole = {r.segment: (r.n, r.tokens) for r in hits.filter("phrase < 0").select("segment", "n", "tokens").collect()}  # a row for each segment
    return _score(_ranked(hits, asks, asked, whole, top) if asked.tokens and whole else passages.sparkSession.createDataFrame([], SCORED))
