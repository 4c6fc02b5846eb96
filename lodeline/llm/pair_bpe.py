"""Byte-level BPE by an index of pair occurrences.

The words that a partition has not met before are laid out as one array of
symbols. An index holds, for each pair that the vocabulary merges, all its
places in that array; pairs lie in order of rank, a band of ranks at a time.
Active ranks are applied in ascending order in every word: of a band's places,
those of each word's least rank are merged together, which makes new pairs;
these go to the lists of their ranks, and places whose pair has gone leave theirs.
Only the file's vocabulary and merges are used; the library itself encodes
nothing here.

A rule's rank is above those that make its parts, so a merge only adds places to
lists that are still to come, or of the band at hand.

Defined results: a null or empty text has no ids and decodes to the empty text;
a special token's string inside a text is that token; equal rows give equal
rows; an empty table gives none. A very long text or word is merged whole: a
word's places of one rank merge together. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, documents, slices, texts_of
from .tokens import BYTE_BPE, MARKS, byte_letters, lines_of, missing, no_cycles, trim, vocabulary_path

#: Fixed value: how the vocabulary's pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranks in a band of the index.
BAND = 2048
#: The rank of a place whose pair is not merged.
NEVER = 1 << 30
_SLOTS = 1 << 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint64) * _SPREAD) >> np.uint64(64 - 19)).astype(np.int64)


class Rules:
    """Ranks of pairs of symbols in a hash table that many places look into at once."""

    def __init__(self, pairs: list[int]):
        pair = np.array(pairs, np.int64)
        self.pair, self.rank = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, NEVER, np.int64)
        at, todo, self.probes = _slot(pair), np.arange(len(pair)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.pair[at[todo]] < 0]
            self.pair[at[free]] = pair[free]  # of several, one stays
            self.rank[at[todo]] = np.where(self.pair[at[todo]] == pair[todo], todo, self.rank[at[todo]])
            todo = todo[self.pair[at[todo]] != pair[todo]]
            at[todo] = (at[todo] + 1) % _SLOTS

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 20 | right
        at, out = _slot(pair), np.full(len(pair), NEVER, np.int64)
        todo = np.arange(len(pair))
        for _ in range(self.probes):
            have = self.pair[at[todo]]
            hit = have == pair[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % _SLOTS
        return out


def _not_overlapping(places: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of ascending places of a word's pair, those that merge from left to
    right: in a run where each overlaps the next, every other one."""
    touches = np.concatenate(([False], places[1:] == following[places[:-1]]))
    if not touches.any():
        return places
    at = np.arange(len(places))
    return places[(at - np.maximum.accumulate(np.where(touches, 0, at))) % 2 == 0]


class PairIndexBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.rules = Rules([(a << 20) | b for a, b, _ in merges])
        self.made = np.array([new for *_, new in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile(PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.words: dict[str, list[int]] = {}
        self.units: dict[str, list[int]] = {}

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of pre-tokens, all merged together."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw])
        symbols = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbols)
        word = np.repeat(np.arange(len(words)), sizes)
        following, before = np.arange(1, n + 1), np.arange(-1, n)
        last = np.cumsum(sizes)[sizes > 0] - 1
        following[last] = n  # no place
        before[np.concatenate(([0], last + 1))[:-1]] = -1
        rank = np.full(n, NEVER, np.int64)
        inner = np.flatnonzero(following < n)
        rank[inner] = self.rules.of(symbols[inner], symbols[inner + 1])
        lists: dict[int, list[np.ndarray]] = defaultdict(list)

        def listed(places: np.ndarray):
            band = rank[places] // BAND
            order = np.argsort(band, kind="stable")
            edge = np.flatnonzero(np.diff(band[order])) + 1
            for part in np.split(places[order], edge):
                if len(part):
                    lists[int(rank[part[0]]) // BAND].append(part)

        listed(np.flatnonzero(rank < NEVER))
        for band in range(len(self.made) // BAND + 1):
            places = np.concatenate(found) if (found := lists.pop(band, None)) else inner[:0]
            while len(places := np.sort(places[rank[places] // BAND == band])):
                places = places[np.diff(places, prepend=-1) > 0]
                mine = rank[places]
                start = np.flatnonzero(np.diff(word[places], prepend=-1))
                least = np.repeat(np.minimum.reduceat(mine, start), np.diff(start, append=len(places)))
                now = _not_overlapping(places[mine == least], following)
                gone = following[now]
                after = following[gone]
                symbols[now], symbols[gone] = self.made[rank[now]], -1
                following[now], before[after], rank[gone] = after, now, NEVER
                left = before[now]
                changed = np.concatenate((now, left[left >= 0]))
                right = following[changed]
                paired = right < n
                rank[changed[~paired]] = NEVER
                changed, right = changed[paired], right[paired]
                rank[changed] = self.rules.of(symbols[changed], symbols[right])
                fresh = changed[rank[changed] < NEVER]
                soon = rank[fresh] // BAND == band
                listed(fresh[~soon])
                places = np.concatenate((places, fresh[soon]))
        stays = symbols >= 0
        ids = symbols[stays].tolist()
        ends = np.cumsum(np.bincount(word[stays], minlength=len(words))).tolist()
        return [ids[x:y] for x, y in zip([0, *ends[:-1]], ends)]

    def _cut(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def _pieces(self, unit: str) -> list[str]:
        """A unit's pre-tokens; most are letters with a mark or line ends between."""
        if "\n" in unit and unit[0] == " " and (lines := lines_of(unit[1:])):
            out = self._pieces(" " + lines[0])
            for line in lines[1:]:
                out += ["\n", *self._pieces(line)]
            return out
        bare = unit[1:] if unit[:1] == " " else unit
        if bare.isascii():
            if bare.isalpha():
                return [unit]
            if bare[-1:] in MARKS and bare[:-1].isalpha():
                return [unit[:-1], unit[-1]]
        return self._cut(unit)

    def _special(self, text: str) -> list[list[str] | int]:
        """Pre-tokens between special tokens, and those tokens' ids."""
        return [self.special[s] if s in self.special else self._cut(s) for s in self.cut_special.split(text)]

    @no_cycles()
    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts. A text is taken apart at single blanks, where the
        pattern always cuts; a unit that starts with white space, or is empty,
        may belong to a longer run, and its text is cut by the pattern whole.
        The memo of units has what follows a blank."""
        trim(self.units)
        trim(self.words)
        units, words, get, parts, new, odd = self.units, self.words, self.units.get, [], set(), {}
        for i, text in enumerate(texts):
            if self.cut_special and any(s in text for s in self.special):
                odd[i] = self._special(text)
                parts.append(None)
                continue
            first, *rest = text.split(" ")
            known = list(map(get, rest))
            unknown = [(k, rest[k]) for k in missing(known)]
            if any(u == "" or u[0].isspace() for _, u in unknown):
                odd[i] = [self._cut(text)]
                parts.append(None)
                continue
            new.update([u for _, u in unknown])
            parts.append((self._pieces(first) if first else [], known, unknown))
        pieces = {u: self._pieces(" " + u) for u in new}
        loose = {w for v in pieces.values() for w in v}
        loose.update(w for x in parts if x for w in x[0])
        loose.update(w for v in odd.values() for x in v if not isinstance(x, int) for w in x)
        lacking = [w for w in loose if w not in words]
        words.update(zip(lacking, self.merge(lacking)))
        together = lambda found: list(chain.from_iterable(map(words.__getitem__, found)))
        units.update((u, words[v[0]] if len(v) == 1 else together(v)) for u, v in pieces.items())
        out = []
        for i, part in enumerate(parts):
            if part is None:
                out.append([t for x in odd[i] for t in ([x] if isinstance(x, int) else together(x))])
                continue
            head, known, unknown = part
            for k, u in unknown:
                known[k] = get(u)
            out.append(together(head) + list(chain.from_iterable(known)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pair_bpe(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encoded(path: str):
    def run(batches):
        bpe = pair_bpe(path)
        for batch in slices(batches, "text"):
            yield batch_of(_IDS, {"doc_id": batch.column(0), "ids": bpe.encode(texts_of(batch))})

    return run


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the ids of each text."""
    return docs.select("doc_id", "text").mapInArrow(_encoded(tokenizer_path), "doc_id bigint, ids array<int>")


def _decoded(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = pair_bpe(path)
        for batch in batches:
            yield batch_of(schema, {"doc_id": batch.column(0), "text": [bpe.decode(x or []) for x in batch.column(1).to_pylist()]})

    return run


def decoded(ids: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text of each array of ids."""
    return ids.select("doc_id", "ids").mapInArrow(_decoded(tokenizer_path), "doc_id bigint, text string")


def _digests(path: str):
    """Encodes and decodes in one pass, so that ids need not leave the worker."""

    def run(batches):
        bpe = pair_bpe(path)
        decimal = bpe.decimal.__getitem__
        for batch in slices(batches, "text"):
            rows = {c: [] for c in _OUT.names[1:]}
            for ids in bpe.encode(texts_of(batch)):
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield batch_of(_OUT, {"doc_id": batch.column(0)} | rows)

    return run


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_digests(tokenizer_path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary_path(BYTE_BPE))
