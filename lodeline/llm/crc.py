"""CRC-32 of very many short byte strings at once, and of their joins."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np

POLYNOMIAL = 0xEDB88320
#: Bytes up to which strings are worked on together; longer ones go to zlib alone.
SHORT = 64


def _step(c: np.ndarray) -> np.ndarray:
    """One zero bit more."""
    return np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    """What each byte adds."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = _step(c)
    return c


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[length, byte of the CRC, its value] -> the CRC after so many zero bytes."""
    values = np.arange(256, dtype=np.uint32)
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.stack([values << np.uint32(8 * k) for k in range(4)])
    for n in range(1, SHORT + 1):
        c = out[n - 1]
        out[n] = _bytes()[c & 255] ^ (c >> 8)
    return out


def of_spans(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRCs of spans of a buffer of bytes."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at, table = np.flatnonzero(size <= SHORT), _bytes()
    for j in range(SHORT):
        at = at[size[at] > j]
        if not len(at):
            break
        c = out[at]
        out[at] = table[(c ^ buf[start[at] + j]) & 255] ^ (c >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(buf[start[i] : start[i] + size[i]])
    return out


def joined(before: np.ndarray, own: np.ndarray, size: np.ndarray, long: Callable[[int], bytes]) -> np.ndarray:
    """The CRCs of strings followed by others, from both CRCs and the others'
    sizes; ``long(i)`` gives the i-th of these if it has over ``SHORT`` bytes."""
    n = np.minimum(size, SHORT)
    t = _shifts()
    out = t[n, 0, before & 255] ^ t[n, 1, (before >> 8) & 255] ^ t[n, 2, (before >> 16) & 255] ^ t[n, 3, before >> 24] ^ own
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(long(i), int(before[i]))
    return out


def sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes in DuckDB's SQL; ``crc_table``
    has to be in scope, from ``TABLE_SQL``."""
    hexed = f"hex(encode({text}))"
    byte = f"list_transform(range(length({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
#: A one-row table of what each byte adds.
TABLE_SQL = f"crc_t AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, x: {_BIT})) AS crc_table)"
