"""Encoding whole texts with the tokenizers library, a memo of units at a time.

A text is cut at single blanks. For the two kinds of vocabulary here such a cut
is a boundary of the pre-tokenizer, so a unit's ids do not depend on its
neighbours and can be remembered; so is a single line end between text. Units for
which that does not hold (empty, or starting with white space: a run of white
space spans the cut) and texts that contain a special token's string are left to
the library as they are.
"""

from __future__ import annotations

import gc
from array import array
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Units that a Python worker remembers, and how many of them, those met first, it keeps when there are more.
MEMO_UNITS, MEMO_KEPT = 600_000, 250_000
#: A mark after letters only is a pre-token of its own.
MARKS = frozenset(",.;:!?")
#: Letters below this have simple lower case and are letters in every Unicode version.
LATIN_END = "\u0250"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself
    where it prints, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@contextmanager
def no_cycles():
    """Many small objects are made here and none that refer to each other in a
    circle: the search for such circles waits."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def trim(memo: dict) -> None:
    """Frequent units are met early: a full memo keeps its oldest ones."""
    if len(memo) > MEMO_UNITS:
        kept = list(islice(memo.items(), MEMO_KEPT))
        memo.clear()
        memo.update(kept)


def missing(known: list) -> list[int]:
    """The places of None."""
    out, at = [], -1
    for _ in range(known.count(None)):
        at = known.index(None, at + 1)
        out.append(at)
    return out


def lines_of(unit: str) -> list[str] | None:
    """The lines of a unit between single line ends, where each is text; a
    single line end between text is always a pre-token of its own."""
    parts = unit.split("\n")
    return parts if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts) else None


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit arrays."""

    def __init__(self, path: str, prefixed: bool):
        """prefixed: a unit carries the blank before it (byte-level BPE);
        otherwise white space is dropped (BPE with word ends). The memo's keys
        are units, or lines without a blank before them after a line end."""
        self.path, self.prefixed = path, prefixed
        self.library = library(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.marks: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {} if prefixed else self.memo

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, units: set[str]) -> None:
        """Remembers new units; the library sees only what cannot be put
        together from known parts."""
        memo, joined = self.memo, []
        if self.prefixed:
            atoms = set()
            for u in units:
                if "\n" in u and (parts := lines_of(u)):
                    keys = [parts[0], *["\n" + p for p in parts[1:]]]
                    joined.append((u, keys))
                    atoms.update(keys)
                else:
                    atoms.add(u)
            units = atoms
        self._learn_atoms([u for u in units if u not in memo])
        for u, keys in joined:
            memo[u] = self._mark("\n").join([memo[k] for k in keys])

    def _learn_atoms(self, atoms: list[str]) -> None:
        memo, prefixed = self.memo, self.prefixed
        marked, folded, stems, rest = [], [], set(), []
        for u in atoms:
            body = u[1:] if u[:1] == "\n" else u
            if body.isalpha():
                stem = u
            elif body[-1:] in MARKS and (body := body[:-1]).isalpha():
                stem = u[:-1]
                marked.append((u, stem))
            else:
                rest.append(u)
                continue
            plain = body.isascii()
            if not plain and (max(body) >= LATIN_END or not prefixed and not is_normalized("NFC", body)):
                stem = None
            elif not prefixed:
                low = stem.lower()
                if not plain and not low.isalpha():
                    stem = None
                elif low != stem:
                    folded.append((stem, low))
                    stem = low
            if stem is None:
                if marked and marked[-1][0] is u:
                    marked.pop()
                rest.append(u)
            elif stem not in memo:
                stems.add(stem)
        tokenize, letters, blank = self.library.model.tokenize, self.letters, self.letters[32] if prefixed else ""
        for stem in stems:  # one pre-token each: straight to the library's model
            bare = stem[0] == "\n"
            word = stem[1:] if bare else stem
            if not word.isascii():
                word = "".join([letters[b] for b in word.encode()])
            memo[stem] = array("I", [t.id for t in tokenize(word if bare else blank + word)]).tobytes()
        texts = [u[1:] if u[:1] == "\n" else (" " if prefixed else "") + u for u in rest]
        for u, e in zip(rest, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            memo[u] = array("I", e.ids).tobytes()
        for u, low in folded:
            memo[u] = memo[low]
        for u, stem in marked:
            memo[u] = memo[stem] + self._mark(u[-1])

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._whole(mark)
        return self.marks[mark]

    def _found(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, learnt where they are new."""
        get = self.memo.get
        found = list(map(get, units))
        unknown = missing(found)
        self._learn({units[i] for i in unknown})
        for i in unknown:
            found[i] = get(units[i])
        return found

    @no_cycles()
    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts are taken apart by Arrow, which also finds their distinct
        units; only these are looked up, and the ids are laid out by numpy."""
        trim(self.memo)
        trim(self.first)
        whole = {i: self._whole(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        column = pa.array([None if i in whole else t if self.prefixed else t.replace("\n", " ") for i, t in enumerate(texts)], pa.large_string())
        split = pc.split_pattern(column.drop_null(), " ")
        offsets, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        codes, units = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = [i for i in range(len(texts)) if i not in whole]
        if self.prefixed:
            # A unit that is empty or starts with white space is part of a longer run; the first of a text has no blank before it.
            unsafe = np.array([not u or u[0].isspace() for u in units], bool)
            flagged = unsafe[codes]
            flagged[offsets[:-1]] = False
            bad = np.flatnonzero(np.add.reduceat(flagged.astype(np.int64), offsets[:-1])) if len(rows) else ()
            whole |= {rows[k]: self._whole(texts[rows[k]]) for k in bad}
            found = self._found([u for u, x in zip(units, unsafe) if not x])
            known = iter(found)
            found = [b"" if x else next(known) for x in unsafe]
            heads = []
            for k, at in enumerate(codes[offsets[:-1]].tolist()):
                head = units[at]
                if (ids := self.first.get(head)) is None:
                    ids = self.first[head] = self._whole(head)
                heads.append(ids)
            codes = codes.copy()
            codes[offsets[:-1]] = np.arange(len(rows)) + len(units)
            found += heads
        else:
            found = self._found(units)
        sizes = np.array([len(x) for x in found], np.int64) // 4
        pool, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        many = sizes[codes]
        ends = np.cumsum(many)
        ids = pool[np.repeat(begin[codes] - (ends - many), many) + np.arange(int(many.sum()))]
        cuts = np.concatenate(([0], ends))[offsets]
        out = [None] * len(texts)
        for k, i in enumerate(rows):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        for i, raw in whole.items():
            out[i] = np.frombuffer(raw, "<u4")
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its kind is read from the file."""
    import json

    with open(path, encoding="utf-8") as f:
        pre = json.load(f)["pre_tokenizer"]
    return Encoder(path, pre["type"] == "ByteLevel")
