"""A compressed full-text index over integer symbols, in numpy.

The Burrows-Wheeler transform of a text lies in a wavelet tree, stored level
by level as packed bits with a count per 64 of them: n log(s) bits and half of
that again for n symbols out of s.  Backward search extends a match to the
left by two rank queries.  All queries of a batch advance together, so a step
costs a few array operations however many there are.

Longest common prefixes are known up to ``cap``, which bounds the suffix
sort's rounds as well: two suffixes that agree on ``cap`` symbols needn't be
told apart.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Ranks of symbols over a sequence: bit k of all symbols is one level, zeros before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        now = symbols
        for k in range(bits - 1, -1, -1):
            bit = (now >> k) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(now) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1])).astype(np.int32)
            self.levels.append((k, words, counts, int(len(now) - bit.sum())))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before at[i]."""
        low, high = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for k, words, counts, zeros in self.levels:
            one = ((symbol >> k) & 1).astype(bool)
            below, above = (counts[p >> 6] + np.bitwise_count(words[p >> 6] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64) for p in (low, high))
            low, high = np.where(one, zeros + below, low - below), np.where(one, zeros + above, high - above)
        return high - low


def suffix_order(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order by their first symbols (a power of two, ``cap`` or more), and each one's common prefix with the one before it, up to ``cap``."""
    n = len(text)
    ranks = [np.append(text.astype(np.int64) + 1, 0)]
    reach = 1
    while reach < cap:
        now = ranks[-1]
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = now[reach:n]
        _, found = np.unique(now[:n] * (int(now.max()) + 1) + after, return_inverse=True)
        ranks.append(np.append(found.reshape(-1) + 1, 0))
        reach *= 2
    order = np.argsort(ranks[-1][:n], kind="stable")
    shared = np.zeros(n, np.int64)
    one, two = order[:-1], order[1:]
    for level in range(len(ranks) - 1, -1, -1):
        a, b = np.minimum(one + shared[1:], n), np.minimum(two + shared[1:], n)
        alike = (ranks[level][a] == ranks[level][b]) & (ranks[level][a] > 0)
        shared[1:] += alike * (1 << level)
    return order, np.minimum(shared, cap)


def _smaller(values: np.ndarray, step: int) -> np.ndarray:
    """The next place with a smaller value, to the left (step -1) or right (1); ends count as smaller."""
    n = len(values)
    held = np.concatenate(([-1], values, [-1]))
    at = np.arange(n + 2) + step
    at[0], at[-1] = 0, n + 1
    todo = np.arange(1, n + 1)
    while len(todo):
        todo = todo[held[at[todo]] >= held[todo]]
        at[todo] = at[at[todo]]
    return at[1:-1] - 1


class FmIndex:
    """Index of sequences of symbols 1..s; 0 separates them."""

    def __init__(self, text: np.ndarray, cap: int):
        self.n, self.cap = len(text), cap
        self.order, lcp = suffix_order(text, cap)
        most = int(text.max(initial=0)) + 1
        self.symbols = most
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=most))))
        self.wavelet = Wavelet(text[self.order - 1], max(1, (most - 1).bit_length()))
        self.lcp = np.append(lcp, 0)
        self.left = _smaller(self.lcp[:-1], -1)
        self.right = np.append(_smaller(self.lcp[:-1], 1), self.n)

    def matches(self, queries: np.ndarray):
        """Matching statistics of queries (m, width), from the last column to the first.

        Yields (column, low, length): ``length`` is that of the longest match
        of the index that begins at the column, up to the cap, and ``low`` the
        first suffix that has it.  Symbols that the index hasn't, and 0, match
        nothing.
        """
        m = len(queries)
        low, high, length = np.zeros(m, np.int64), np.full(m, self.n), np.zeros(m, np.int64)
        for column in range(queries.shape[1] - 1, -1, -1):
            symbol = queries[:, column]
            known = (symbol > 0) & (symbol < self.symbols)
            full = np.flatnonzero(length == self.cap)
            self._shorten(full, low, high, length, self.cap - 1)
            todo = np.flatnonzero(known)
            while len(todo):
                c = symbol[todo]
                both = self.wavelet.ranks(np.concatenate((c, c)), np.concatenate((low[todo], high[todo])))
                a, b = self.starts[c] + both[: len(c)], self.starts[c] + both[len(c) :]
                hit = a < b
                got = todo[hit]
                low[got], high[got] = a[hit], b[hit]
                length[got] += 1
                todo = todo[~hit]
                lost = todo[length[todo] == 0]
                low[lost], high[lost] = 0, self.n
                todo = todo[length[todo] > 0]
                self._shorten(todo, low, high, length)
            unknown = np.flatnonzero(~known)
            low[unknown], high[unknown], length[unknown] = 0, self.n, 0
            yield column, low, length

    def _shorten(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray, to: int | None = None) -> None:
        """Drop symbols from the matches' right ends: to the next length with more matches, or to ``to``."""
        if not len(rows):
            return
        a, b = self.lcp[low[rows]], self.lcp[high[rows]]
        a[low[rows] == 0] = 0
        b[high[rows] == self.n] = 0
        most = np.maximum(a, b)
        wide = np.ones(len(rows), bool) if to is None else most >= to
        length[rows] = most if to is None else to
        go, a, b, most = rows[wide], a[wide], b[wide], most[wide]
        left, right = a == most, b == most
        empty = most == 0
        new_low = np.where(left, self.left[low[go]], low[go])
        new_high = np.where(right, self.right[high[go]], high[go])
        low[go], high[go] = np.where(empty, 0, np.maximum(new_low, 0)), np.where(empty, self.n, new_high)
