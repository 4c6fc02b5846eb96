"""MD5 of many short strings at once."""

from __future__ import annotations

from hashlib import md5

import numpy as np

#: Strings that are worked on at once; bytes that one block holds.
CHUNK, SHORT = 8192, 55
_K = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first word of the hashes of one-block messages, by their words; those that are left out are 0."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, _K[i], out=f)
        if at in words:
            np.add(f, words[at], out=f)
        turn = np.uint32(_TURNS[kind][i % 4])
        np.left_shift(f, turn, out=g), np.right_shift(f, np.uint32(32) - turn, out=f), np.bitwise_or(f, g, out=f), np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_START[0])


def md5_heads(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, the first one the lowest, of the MD5 of
    each of many parts of ``data``."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length.astype(np.uint16) if length.max(initial=0) < 1 << 16 else length, kind="stable")
    short = int(np.searchsorted(length[order], SHORT, side="right"))
    padded = np.append(data, np.zeros(64, np.uint8))
    for k in range(0, short, CHUNK):
        some = order[k : min(k + CHUNK, short)]
        size = length[some]
        wide = (int(size[-1]) // 4 + 1) * 4
        column = np.arange(wide)
        held = padded[start[some][:, None] + column]
        held[column >= size[:, None]] = 0
        held[np.arange(len(some)), size] = 0x80
        words = dict(enumerate(np.ascontiguousarray(held.view("<u4").T)))
        words[14] = words.get(14, np.uint32(0)) + (size * 8).astype(np.uint32)
        out[some] = _block(words, len(some))
    for i in order[short:].tolist():
        out[i] = int.from_bytes(md5(data[start[i] : start[i] + length[i]].tobytes(), usedforsecurity=False).digest()[:4], "little")
    return out
