"""Simple-8b coding of id streams in numpy.

A 64-bit word holds a 4-bit selector above 60 bits of payload; the selector
says how many ids of which width the payload packs. Ids wider than 30 bits are
escapes: alone in a word if they have at most 60 bits, else in the whole word
after an empty one. A stream is coded in blocks of a fixed number of ids, and
the word at which each block starts is kept, so that blocks can be decoded by
themselves and all of them at once.
"""

from __future__ import annotations

import numpy as np

#: (ids, bits) by selector; 14 is the escape of one id, 15 the escape of a raw word.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 30), (1, 60), (1, 64)]
BLOCK = 4096
_ESCAPE, _RAW = 14, 15


def _choices(ids: np.ndarray, block: int) -> np.ndarray:
    """For each place, the selector that packs most ids from there on, up to
    the end of its block."""
    n = len(ids)
    if ids.max() < np.uint64(1 << 53):  # exact as floats, whose exponents are the bits
        bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    else:
        bits = np.array([int(x).bit_length() for x in ids.tolist()], np.uint8)
    pick = np.where(bits <= 60, np.uint8(_ESCAPE), np.uint8(_RAW))
    widest = {1: bits}  # widest id among the next so many
    step = 1
    while step < 32:
        wide = widest[step].copy()
        if n > step:
            np.maximum(wide[:-step], widest[step][step:], out=wide[:-step])
        widest[2 * step] = wide
        step *= 2
    left = np.minimum(block - np.arange(n) % block, n - np.arange(n))
    for sel in range(_ESCAPE - 1, -1, -1):
        count, width = PACKS[sel]
        half = 1 << (count.bit_length() - 1)
        if count > n or widest[half].min() > width:
            continue
        most = widest[half][: n - count + 1]
        if count > half:
            most = np.maximum(most, widest[half][count - half : n - half + 1])
        pick[: n - count + 1][(most <= width) & (left[: n - count + 1] >= count)] = sel
    return pick


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words, and for each block the word at which it starts."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pick = _choices(ids, block)
    jumps, places, i = np.array([c for c, _ in PACKS], np.int64)[pick].tolist(), [], 0
    while i < n:
        places.append(i)
        i += jumps[i]
    place = np.array(places)
    sel = pick[place]
    raw = sel == _RAW
    to = np.arange(len(place)) + np.cumsum(raw) - raw
    out = np.zeros(len(place) + int(raw.sum()), np.uint64)
    word = sel.astype(np.uint64) << np.uint64(60)
    for s in np.flatnonzero(np.bincount(sel)).tolist():
        mine, (count, width) = np.flatnonzero(sel == s), PACKS[s]
        if s == _RAW:
            out[to[mine] + 1] = ids[place[mine]]
            continue
        for k in range(count):
            word[mine] |= ids[place[mine] + k] << np.uint64(k * width)
    out[to] = word
    return out, to[np.searchsorted(place, np.arange(0, n, block))]


def decode(words: np.ndarray, starts: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to before ``last``, all decoded together."""
    last = len(starts) if last is None else last
    if first >= last:
        return np.zeros(0, np.uint64)
    words = np.asarray(words, np.uint64)[starts[first] : starts[last] if last < len(starts) else len(words)]
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    raw = np.flatnonzero(sel == _RAW)
    if len(raw):  # the word after a raw escape may look like one: walk these few
        after, last_raw = set(), -2
        for i in raw.tolist():
            if i - 1 == last_raw and i in after:
                continue
            after.add(i + 1)
            last_raw = i
        head[sorted(after)] = False
    place = np.flatnonzero(head)
    sel = sel[place]
    counts = np.array([c for c, _ in PACKS], np.int64)[sel]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(sel):
        mine, (count, width) = sel == s, PACKS[s]
        begin = (ends - counts)[mine]
        if s == _RAW:
            out[begin] = words[place[mine] + 1]
            continue
        values = words[place[mine]][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))
        out[begin[:, None] + np.arange(count)] = values & np.uint64((1 << width) - 1)
    return out
