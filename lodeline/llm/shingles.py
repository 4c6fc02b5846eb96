"""Word shingles of many texts at once, hashed in numpy."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_backs = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _backs
    if len(_powers) < n:
        size = 1 << n.bit_length()
        _powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE))))
        _backs = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BACK))))
    return _powers, _backs


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every lower-cased word, and for each text the number of
    words in it and all before."""
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    word = _IS_WORD[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    powers, backs = _tables(len(buf))
    sums = np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * powers[: len(buf)])
    hashes = mix((sums[end - 1] - sums[start - 1]) * backs[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return hashes, np.searchsorted(start, ends, side="right")


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """For each text, the sorted hashes of its distinct shingles; a text with
    fewer words is one shingle, a text without words has none."""
    hashes, upto = word_hashes(texts)
    joined = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        part = hashes[k:]
        joined[: len(part)] = mix(joined[: len(part)] * np.uint64(3) + part)
    out, a = [], 0
    for b in upto.tolist():
        n = b - a
        if n >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for i in range(a, b):
                h = mix(h * np.uint64(5) + hashes[i : i + 1])
            out.append(h)
        else:
            out.append(joined[:0])
        a = b
    return out


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


#: Cells for parities at most.
CELLS = 4096


def parities(s: np.ndarray) -> bytes:
    """A bit for each of 64 to ``CELLS`` cells, twice as many as hashes or more up to
    that: whether the cell holds an odd number of the set's hashes."""
    cells = min(CELLS, max(64, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def folded(odd: bytes, size: int) -> bytes:
    """The parities of the same set over fewer cells, in ``size`` bytes."""
    if len(odd) == size:
        return odd
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.uint8).reshape(-1, size), axis=0).tobytes()


def differ_at_most(apart, sizes, percent: int):
    """Whether two sets of ``sizes`` hashes together, of which at least ``apart`` are in
    one set only, may be alike enough: 100 * (sizes - d) >= percent * (sizes + d)."""
    return (100 + percent) * apart <= (100 - percent) * sizes
