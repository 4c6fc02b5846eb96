"""Front-coded sorted runs of byte strings and their merging by a loser tree.

A run keeps of each string only what follows the prefix that it shares with the
string before. In the merge, every waiting string knows how far it agrees with
the last one put out: of two, the one that agrees longer is the lesser without
any comparison, and equal ones are compared from there on only.
"""

from __future__ import annotations

import numpy as np


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Of sorted rows of bytes, how many leading bytes each shares with the one before."""
    if not len(rows):
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate(([0], first))


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths and the joined rests of sorted rows of equal width."""
    shared = common_prefixes(rows)
    keep = np.arange(rows.shape[1])[None, :] >= shared[:, None]
    return shared, rows[keep].tobytes()


def decoded(shared: np.ndarray, rests: bytes, width: int) -> np.ndarray:
    """The rows of a front-coded run."""
    rows = np.zeros((len(shared), width), np.uint8)
    keep = np.arange(width)[None, :] >= shared[:, None]
    rows[keep] = np.frombuffer(rests, np.uint8)
    for c in range(int(shared.max(initial=0))):  # fill prefixes down, column by column
        known = np.where(keep[:, c], np.arange(len(shared)), 0)
        rows[:, c] = rows[np.maximum.accumulate(known), c]
    return rows


class LoserTree:
    """Merges sorted runs. Each node keeps the loser of its match; a string's
    agreement is counted against the last string put out."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, self.k = runs, 1
        while self.k < len(runs):
            self.k *= 2
        self.at = [0] * self.k
        self.agree = [0] * self.k
        self.node = [-1] * self.k
        self.compared = 0
        self.winner = self._build(1)

    def _head(self, r: int):
        return self.runs[r][0][self.at[r]] if r < len(self.runs) and self.at[r] < len(self.runs[r][0]) else None

    def _match(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's agreement becomes that with the winner."""
        a, b = self._head(x), self._head(y)
        if b is None:
            return x, y
        if a is None:
            return y, x
        ax, ay = self.agree[x], self.agree[y]
        if ax != ay:
            return (x, y) if ax > ay else (y, x)
        i = ax
        n = min(len(a), len(b))
        if a[i:] == b[i:]:
            i = n
        else:
            while i < n and a[i] == b[i]:
                i += 1
        self.compared += i - ax + 1
        if i == n and len(a) == len(b) or (i == n and len(a) < len(b)) or (i < n and a[i] < b[i]):
            self.agree[y] = i
            return x, y
        self.agree[x] = i
        return y, x

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        win, self.node[node] = self._match(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self):
        """(run, place in the run, agreement with the string before)."""
        while self._head(self.winner) is not None:
            r = self.winner
            yield r, self.at[r], self.agree[r]
            self.at[r] += 1
            strings, shared = self.runs[r]
            # The next of this run shares with the one just put out what the run says.
            self.agree[r] = shared[self.at[r]] if self.at[r] < len(strings) else 0
            x, node = r, (r + self.k) >> 1
            while node:
                x, self.node[node] = self._match(x, self.node[node])
                node >>= 1
            self.winner = x


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of runs (rows, shared prefixes): the order of all rows laid end to end,
    and each one's agreement with the one before."""
    base = np.concatenate(([0], np.cumsum([len(rows) for rows, _ in runs]))).tolist()
    tree = LoserTree([([r.tobytes() for r in rows], shared.tolist()) for rows, shared in runs])
    order, agree = [], []
    for r, i, n in tree:
        order.append(base[r] + i)
        agree.append(n)
    return np.array(order, np.int64), np.array(agree, np.int64)
