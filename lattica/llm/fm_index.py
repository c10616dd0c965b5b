"""FM-index over a sequence of small integers: suffix order, wavelet matrix, backward search and location, in array form."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Ascending order of the suffixes of ``symbols``, of which 0 is a separator that ends each comparison.

    The separators count as symbols of their own, smaller than all others and ordered by place. Ranks are refined by
    prefix doubling, on the suffixes alone that still tie: as no comparison passes a separator, these soon are few.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    place = max(1, (n - 1).bit_length())
    depth = min(n, max(1, (63 - place) // bits))
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for d in range(depth):
        there = np.zeros(n, np.int64)
        there[: n - d] = symbols[d:]
        there[~alive] = 0
        alive &= there > 0
        key = (key << bits) | there
    packed = np.sort((key << place) | np.arange(n))
    order, key = packed & ((1 << place) - 1), packed >> place
    new = np.append(True, key[1:] != key[:-1]) | ~alive[order]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(tied):
        at = order[tied]
        pair = np.stack([rank[at], rank[np.minimum(at + depth, n - 1)]])
        if 3 * place <= 63:
            packed = np.sort((pair[0] << (2 * place)) | (pair[1] << place) | at)
            at = packed & ((1 << place) - 1)
        else:
            at = at[np.lexsort((pair[1], pair[0]))]
        order[tied] = at
        first, second = rank[at], rank[np.minimum(at + depth, n - 1)]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~new | ~np.append(new[1:], True)]
        depth *= 2
    return order


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols, and how often each occurs before any place, in one bit vector per bit."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, BitVector, int]] = []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b) & 1 == 1
            self.levels.append((b, BitVector(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the occurrences of ``symbol`` before ``at`` end in the last level; differences are rank."""
        for b, vector, zeros in self.levels:
            ones = vector.ones(at)
            at = np.where((symbol >> b) & 1 == 1, zeros + ones, at - ones)
        return at

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some places, and what ``follow`` gives for them."""
        symbol = np.zeros(len(at), np.int64)
        for b, vector, zeros in self.levels:
            bit = vector.get(at).astype(np.int64)
            ones = vector.ones(at)
            symbol |= bit << b
            at = np.where(bit == 1, zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    """Index of a text of symbols below ``2**bits``; 0 separates its parts and is in no phrase.

    Of the suffix order only the positions divisible by ``sample`` are kept, and those behind a separator, where a walk
    to the left must end.
    """

    def __init__(self, symbols: np.ndarray, bits: int, sample: int = 8) -> None:
        symbols = np.asarray(symbols, np.int64)
        order = suffix_order(symbols)
        before = np.where(order > 0, symbols[order - 1], 0)
        self.matrix = WaveletMatrix(before, bits)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        every = np.arange(1 << bits)
        self.origin = self.matrix.follow(every, np.zeros(len(every), np.int64))
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.places = BitVector(kept), order[kept]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.matrix.follow(symbol, at) - self.origin[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffix order, one per row of ``phrases``, whose suffixes begin with it."""
        last = phrases[:, -1]
        low, high = self.less[last], self.less[last + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            open_ = np.flatnonzero(high > low)
            s = phrases[open_, k]
            low[open_], high[open_] = self._step(s, low[open_]), self._step(s, high[open_])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of some rows of suffix order: steps to the left until a kept position."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            done = self.kept.get(rows) == 1
            out[todo[done]] = self.places[self.kept.ones(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            symbol, ends = self.matrix.get(rows)
            rows = self.less[symbol] + ends - self.origin[symbol]
            steps += 1
        return out
