"""FM-index over whole-number symbols with bit-packed wavelet levels, in numpy.

Searches are vectorised: many patterns take each backward step together."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A bit vector packed in 64-bit words, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        held = np.zeros(len(bits) // 64 + 1 << 6, np.uint8)
        held[: len(bits)] = bits
        self.words = np.packbits(held, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, upto: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        word = upto >> 6
        below = (_ONE << (upto & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class Wavelet:
    """A sequence of symbols as one bit vector per bit of a symbol, the highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.depth - 1, -1, -1):
            bit = symbols >> b & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        # where each symbol's run begins in the last order
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.ones(at)
            at = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of each place."""
        return self._down(symbol, upto) - self.first[symbol]


def suffix_order(symbols: np.ndarray, sigma: int) -> np.ndarray:
    """Places in the order of their suffixes; a suffix that ends is less than those that go on.

    Larsson-Sadakane refinement: suffixes are ranked by as many symbols as a number holds; then, with
    the length doubling, only groups of equal rank are sorted again by the rank that far ahead."""
    n, bits = len(symbols), max(1, int(sigma).bit_length())
    h = max(1, 63 // bits)
    held = np.concatenate([symbols + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << bits | held[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True))) if n else np.zeros(0, np.int64)
    while len(slots):
        places = order[slots]
        ahead = np.where(places + h < n, rank[np.minimum(places + h, n - 1)] + 1, 0)
        key = rank[places] << 32 | ahead
        by = np.argsort(key, kind="stable")
        key, places = key[by], places[by]
        order[slots] = places
        changed = np.ones(len(slots), bool)
        changed[1:] = key[1:] != key[:-1]
        rank[places] = np.maximum.accumulate(np.where(changed, slots, 0))
        slots = slots[~(changed & np.append(changed[1:], True))]
        h *= 2
    return order


class FMIndex:
    """An index over a text of symbols 0 .. sigma - 1; symbol 0 only separates and is never searched for.

    depth is the length up to which matches are told: slots whose suffixes share depth symbols form a
    class, and a match of that length is a class. The suffix array is needed to build the index only;
    value() turns a number of every text place into the least one of each class while it is there."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, values: np.ndarray):
        n = len(text)
        order = suffix_order(text, sigma)
        # the text is followed by one end sign, less than all: its row is the first and stands for the separator in front of all
        last = np.concatenate([text[-1:], np.where(order > 0, text[order - 1], 0)]) if n else np.zeros(1, np.int64)
        self.sigma, self.depth, self.size = sigma, depth, n + 1
        self.wavelet = Wavelet(last, sigma)
        counts = np.bincount(text, minlength=sigma)
        self.before = 1 + np.cumsum(counts) - counts
        held = np.concatenate([text, np.full(depth, -1, np.int64)])
        # suffixes share depth symbols with the one before, none of them a separator
        same = np.zeros(n, bool)
        active = np.arange(1, n)
        for k in range(depth):
            active = active[held[order[active] + k] == held[order[active - 1] + k]]
        same[active] = True
        starts = np.concatenate([[True], ~same])
        self.starts = np.flatnonzero(starts)
        self.marks = Bits(starts)
        by_slot = np.concatenate([[np.iinfo(np.int64).max], values[order]])
        self.least = np.minimum.reduceat(by_slot, self.starts)

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of each range's strings with a symbol put in front; none for symbol 0 or unknown ones."""
        known = (symbol > 0) & (symbol < self.sigma)
        symbol = np.where(known, symbol, 0)
        low, high = (self.before[symbol] + self.wavelet.rank(symbol, x) for x in (low, high))
        return low, np.where(known, high, low)

    def classes(self, slot: np.ndarray) -> np.ndarray:
        return self.marks.ones(slot + 1) - 1

    def search(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of each pattern symbols[start : start + length], from its last symbol to its first."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.size, np.int64)
        for k in range(int(length.max(initial=0))):
            on = np.flatnonzero((k < length) & (low < high))
            low[on], high[on] = self.back(symbols[start[on] + length[on] - 1 - k], low[on], high[on])
        return low, high

    def _longest(self, symbols: np.ndarray, start: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The greatest length up to `most` at which each string from `start` on occurs, by halving, and its slots."""
        good, bad = np.zeros(len(start), np.int64), most + 1
        while len(on := np.flatnonzero(bad - good > 1)):
            middle = (good[on] + bad[on]) // 2
            low, high = self.search(symbols, start[on], middle)
            found = low < high
            good[on[found]], bad[on[~found]] = middle[found], middle[~found]
        return good, *self.search(symbols, start, good)

    def matching(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed texts symbols[start : start + length], capped at depth.

        Three arrays of a value for every place of the texts, one text after the other: the length of the longest string from
        there on that the index has, and the range of its slots. All texts go backward together: a
        match grows by one symbol in front; one of depth symbols stays that long by widening its range
        to its class; where the symbol can't be put in front, the match is looked for anew."""
        offsets = np.cumsum(length) - length
        total = int(length.sum())
        match, lows, highs = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, self.size, np.int64)
        low, high, now = np.zeros(len(start), np.int64), np.full(len(start), self.size, np.int64), np.zeros(len(start), np.int64)
        for k in range(int(length.max(initial=0))):
            on = np.flatnonzero(k < length)
            place = start[on] + length[on] - 1 - k
            a, b = self.back(symbols[place], low[on], high[on])
            grown = now[on] + 1
            full = np.flatnonzero((a < b) & (grown > self.depth))
            which = self.classes(a[full])
            a[full], b[full] = self.starts[which], np.append(self.starts, self.size)[which + 1]
            lost = np.flatnonzero(a >= b)
            if len(lost):
                grown[lost], a[lost], b[lost] = self._longest(symbols, place[lost], np.minimum(grown[lost] - 1, self.depth))
            low[on], high[on], now[on] = a, b, np.minimum(grown, self.depth)
            at = offsets[on] + length[on] - 1 - k
            match[at], lows[at], highs[at] = now[on], a, b
        return match, lows, highs
