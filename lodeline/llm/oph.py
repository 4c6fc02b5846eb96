"""One-permutation hashing with optimal densification, in numpy."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from .shingles import mix

BINS = 128
#: Places that an empty bin looks at, in its own random order, before the first full bin serves.
PROBES = 512


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """For each bin, the bins it borrows from, in order: the same for every set."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(PROBES) + np.arange(PROBES, dtype=np.uint64)[None, :]
    return (mix(at + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)).astype(np.int64) % bins


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least hash in each bin of a sorted set of 64-bit hashes; an empty
    bin takes that of the first full bin in its probing order."""
    where = (hashes >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    full = np.zeros(bins, bool)
    full[where[first]] = True
    out = np.zeros(bins, np.uint64)
    out[where[first]] = hashes[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _probes(bins)[empty]
        for lo, hi in ((0, 16), (16, PROBES)):
            hit = full[probes[:, lo:hi]]
            got = hit.any(axis=1)
            out[empty[got]] = out[probes[got, lo + hit[got].argmax(axis=1)]]
            empty, probes = empty[~got], probes[~got]
            if not len(empty):
                break
        out[empty] = hashes[0]
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` bins."""
    parts = sig.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        key = mix(key * np.uint64(3) + parts[:, k])
    return key


def sketch(sig: np.ndarray) -> np.ndarray:
    """A bit for each bin, as 64-bit words: two sets agree in about half the
    bits, and in half of the rest by their similarity."""
    bits = (mix(sig ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
