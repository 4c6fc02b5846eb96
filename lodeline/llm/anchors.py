"""Anchors of texts: places that equal windows of bytes choose alike.

Of the starts of all GRAM-byte strings in a window, the one with the least hash
is the window's anchor (the leftmost of equals). Windows with equal bytes have
their anchors at the same offset, so two occurrences of a repeated window always
meet at an anchor. Neighbouring windows mostly share theirs: about one anchor
stands for eighty windows.
"""

from __future__ import annotations

import numpy as np

from .shingles import _tables, mix

GRAM = 32


def anchors(buf: np.ndarray, starts: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end in ``buf`` (``starts`` has their begins and the
    end): places of anchors, the hashes of their grams, and the first and last
    window start that each stands for."""
    none = np.zeros(0, np.int64)
    n, span = len(buf), window - gram + 1
    if n < window:
        return none, none.astype(np.uint64), none, none
    powers, backs = _tables(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[:n])))
    hashes = mix((sums[gram:] - sums[:-gram]) * backs[: n - gram + 1])
    # Hash above, place below: one minimum tells both. The split is fixed, so
    # that equal windows of any two buffers settle equal upper halves alike.
    low = 32
    key = ((hashes >> np.uint64(low)) << np.uint64(low)) | np.arange(len(hashes), dtype=np.uint64)
    count = n - window + 1
    pad = -len(key) % span
    blocks = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[span - 1 : span - 1 + count])
    place = (least & np.uint64((1 << low) - 1)).astype(np.int64)
    valid = np.zeros(count + 1, bool)
    sizes = np.diff(starts)
    for a, size in zip(starts[:-1][sizes >= window].tolist(), sizes[sizes >= window].tolist()):
        valid[a : a + size - window + 1] = True
    valid = valid[:count]
    new = valid & np.concatenate(([True], (place[1:] != place[:-1]) | ~valid[:-1]))
    first = np.flatnonzero(new)
    end = valid & np.concatenate(((place[1:] != place[:-1]) | ~valid[1:], [True]))
    last = np.flatnonzero(end)
    at = place[first]
    return at, hashes[at], first, last
