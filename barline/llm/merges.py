"""Merge-type (byte pair) encoding of many words at once.

``MergeTable`` maps an adjacent pair of symbols to the rank at which it merges and to the symbol it makes. A word's
agenda holds the ranks of its adjacent pairs; the best one merges first, the leftmost of equals, and only the two pairs
beside it change. Short words are rows of a matrix and take one merge each per step; a long one has a heap of its own.
"""

from __future__ import annotations

import heapq

import numpy as np

_NONE = np.int32(2**31 - 1)
_WIDTHS = (4, 8, 12, 16, 24, 32, 64)


class MergeTable:
    """``left``, ``right``: symbols of each merge; ``rank``: its rank; ``made``: the symbol it makes. Symbols lie below ``symbols``.

    Pairs may share a rank; then the leftmost goes first.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, symbols: int):
        self.symbols = symbols
        key = left.astype(np.int64) * symbols + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = np.append(key[order], np.iinfo(np.int64).max), np.append(rank[order], _NONE).astype(np.int32), made[order].astype(np.int32)
        self.pairs: dict[int, tuple[int, int]] | None = None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; where a symbol is negative or the pair doesn't merge, a number above all ranks."""
        key = a.astype(np.int64) * self.symbols + b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def encode(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words ``symbols[at[i]:at[i+1]]`` after all merges, laid out the same way."""
        lengths = np.diff(at)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their new lengths, their symbols
        low = 1
        one = np.flatnonzero(lengths == 1)
        out.append((one, np.ones(len(one), np.int64), symbols[at[one]]))
        for width in _WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for i in range(0, len(rows), 50_000):
                out += self._matrix(symbols, at, rows[i : i + 50_000], width)
        for row in np.flatnonzero(lengths > low).tolist():
            merged = self._heap(symbols[at[row] : at[row + 1]].tolist())
            out.append((np.array([row]), np.array([len(merged)]), np.array(merged, np.int32)))
        new = np.zeros(len(lengths), np.int64)
        for rows, n, _ in out:
            new[rows] = n
        starts = np.concatenate([[0], np.cumsum(new)])
        flat = np.empty(starts[-1], np.int32)
        for rows, n, values in out:
            if len(rows):
                flat[np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(values))] = values
        return flat, starts

    def _matrix(self, symbols, at, rows, width):
        column = np.arange(width)
        have = column < np.diff(at)[rows][:, None]
        s = np.where(have, symbols[np.minimum(at[rows][:, None] + column, len(symbols) - 1)], -1).astype(np.int32)
        r = self.rank(s[:, :-1], s[:, 1:])
        done = []
        while len(rows):
            j = r.argmin(axis=1)
            best = r[np.arange(len(rows)), j]
            live = best != _NONE
            if not live.all():
                own = s[~live]
                done.append((rows[~live], (own >= 0).sum(axis=1), own[own >= 0]))
                rows, s, r, j, best = rows[live], s[live], r[live], j[live], best[live]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            after = column > j[:, None]
            made = self.made[np.searchsorted(self.keys, s[n, j].astype(np.int64) * self.symbols + s[n, j + 1])]
            s = np.take_along_axis(s, np.minimum(column + after, width - 1), axis=1)
            s[:, -1] = np.where(after[:, -1], -1, s[:, -1])
            s[n, j] = made
            pair = column[:-1]
            later = pair > j[:, None]
            r = np.take_along_axis(r, np.minimum(pair + later, width - 2), axis=1)
            r[:, -1] = np.where(later[:, -1], _NONE, r[:, -1])
            right = np.minimum(j + 1, width - 1)
            fresh = np.where(j + 1 < width, self.rank(s[n, j], s[n, right]), _NONE)
            inside = j < width - 1
            r[n[inside], j[inside]] = fresh[inside]
            has = j > 0
            r[n[has], j[has] - 1] = self.rank(s[n[has], j[has] - 1], s[n[has], j[has]])
        return done

    def _heap(self, s: list[int]) -> list[int]:
        if self.pairs is None:
            self.pairs = dict(zip(self.keys[:-1].tolist(), zip(self.ranks[:-1].tolist(), self.made.tolist(), strict=True), strict=True))
        n, find, m = len(s), self.pairs.get, self.symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(k[0], i, k[1], s[i], s[i + 1]) for i in range(n - 1) if s[i] >= 0 <= s[i + 1] and (k := find(s[i] * m + s[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, made, a, b = heapq.heappop(agenda)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = made, -9
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 <= y and s[x] >= 0 <= s[y] and (k := find(s[x] * m + s[y])) is not None:
                    heapq.heappush(agenda, (k[0], x, k[1], s[x], s[y]))
        return [x for x in s if x != -9]
