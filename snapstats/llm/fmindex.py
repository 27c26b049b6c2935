"""An FM-index over a sequence of symbols, with numpy: all patterns step through the index at once."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes in order, by rank doubling; a suffix that ends is smaller than one that goes on."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        rank, width = new, 2 * width
        if not n or rank[order[-1]] == n - 1 or width >= n:
            return np.argsort(rank, kind="stable")


class WaveletRanks:
    """Rank and access over a sequence in one bit vector per bit of a symbol, the highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
            zeros = len(values) - int(ones[-1])
            self.levels.append((shift, bit, ones, zeros))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its ``end``."""
        begin = np.zeros(len(end), np.int64)
        for shift, _, ones, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            end = np.where(one, zeros + ones[end], end - ones[end])
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for shift, bit, ones, zeros in self.levels:
            one = bit[at]
            out |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """``symbols`` are above 0; a 0 ends the sequence. Every ``every``-th position is sampled."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, every: int = 8):
        text = np.append(symbols.astype(np.int64), 0)
        order = suffix_order(text)
        last = text[order - 1]
        self.ranks = WaveletRanks(last, max(1, int(n_symbols).bit_length()))
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.sampled = order % every == 0
        self.sample = order[self.sampled]
        self.samples = np.concatenate([[0], np.cumsum(self.sampled)])
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``patterns``, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = patterns[live, step].astype(np.int64)
            low[live] = self.begin[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.begin[symbol] + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each suffix: back to the nearest sampled one, and as many steps on."""
        at, steps, live = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live := live[~self.sampled[at[live]]]):
            symbol = self.ranks.access(at[live])
            at[live] = self.begin[symbol] + self.ranks.rank(symbol, at[live])
            steps[live] += 1
        return self.sample[self.samples[at]] + steps

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pattern, position) of every occurrence."""
        low, high = self.search(patterns)
        n = high - low
        which = np.repeat(np.arange(len(patterns)), n)
        return which, self.locate(np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which])
