"""A compressed full-text index of integer sequences: BWT in a wavelet matrix.

The suffixes are sorted by their first ``DEPTH`` symbols, which is enough for patterns up to
that length.  All methods work on arrays of queries.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


class Bits:
    """A bit vector in 64-bit words with the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int32)


class WaveletMatrix:
    """Sequence of symbols below ``sigma`` with rank by symbol, one bit vector per level."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(sigma, dtype=np.int64)
        self.start = self._follow(every, np.zeros(sigma, dtype=np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - i) & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._follow(symbol, at) - self.start[symbol]


class FMIndex:
    """Index of sequences parted by zeros; ``text`` ends with a zero."""

    def __init__(self, text: np.ndarray, sigma: int, window: int) -> None:
        n = len(text)
        rank, width = text.astype(np.int32), 1
        # Ranks by as many symbols as the binary digits of the window ask for.
        kept = {1: rank} if window & 1 else {}
        while width < DEPTH:
            rank = self._paired(rank, rank, width)
            width *= 2
            if window & width:
                kept[width] = rank
        self.suffixes = np.argsort(rank).astype(np.int32)
        del rank
        # Suffixes with the same first ``window`` symbols stand together: mark the groups.
        group, have = None, 0
        for size in sorted(kept, reverse=True):
            group = kept[size] if group is None else self._paired(group, kept[size], have)
            have += size
        ordered = group[self.suffixes]
        del kept, group
        first = np.ones(n, dtype=bool)
        first[1:] = ordered[1:] != ordered[:-1]
        self.group_start = np.flatnonzero(first)
        self.group_of = (np.cumsum(first) - 1).astype(np.int32)
        self.bwt = WaveletMatrix(text[self.suffixes - 1].astype(np.int32), sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    @staticmethod
    def _paired(left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
        """Dense ranks of pairs of ranks that stand ``apart`` places from each other."""
        n = len(left)
        key = left.astype(np.int64) * (int(right.max(initial=0)) + 2)
        key[: n - apart] += right[apart:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(n, dtype=bool)
        new[1:] = key[1:] != key[:-1]
        ranks = np.empty(n, dtype=np.int32)
        ranks[order] = np.cumsum(new, dtype=np.int32)
        return ranks

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray):
        """One step of backward search: intervals of the patterns with ``symbol`` in front."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.before[symbol]
        return base + both[: len(low)], base + both[len(low) :]


def matching_statistics(
    index: FMIndex, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """For every place of the streamed sequences: how far it matches the index, up to
    ``window`` symbols, and, where that is the whole window, the group of its occurrences.

    Sequences run in step, each from its end to its start.  A match of more than ``window``
    symbols is shortened to it; where no longer match exists, the longest one is found again
    from the current place, symbol by symbol to the right end of what is known to match.
    """
    total = int(lengths.sum())
    length = np.zeros(total, dtype=np.int32)
    group = np.full(total, -1, dtype=np.int64)
    out = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, out = starts[order], lengths[order], out[order]
    low = np.zeros(len(order), dtype=np.int64)
    high = np.full(len(order), len(index.suffixes), dtype=np.int64)
    size = np.zeros(len(order), dtype=np.int32)
    ends = np.append(index.group_start[1:], len(index.suffixes))
    for step in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -step, side="left"))  # sequences this long
        place = lengths[:n] - 1 - step
        symbol = symbols[starts[:n] + place]
        a, b = index.extend(low[:n], high[:n], symbol)
        grown = np.where(b > a, size[:n] + 1, 0).astype(np.int32)
        lost = np.flatnonzero(b <= a)
        if len(lost):
            a[lost], b[lost], grown[lost] = _again(
                index, symbols, starts[lost] + place[lost], size[lost]
            )
        long = np.flatnonzero(grown > window)
        if len(long):
            g = index.group_of[a[long]]
            a[long], b[long], grown[long] = index.group_start[g], ends[g], window
        low[:n], high[:n], size[:n] = a, b, grown
        length[out[:n] + place] = grown
        full = np.flatnonzero(grown == window)
        group[out[:n][full] + place[full]] = index.group_of[a[full]]
    return length, group


def _again(index: FMIndex, symbols: np.ndarray, at: np.ndarray, most: np.ndarray):
    """Longest match from each place, of at most ``most`` symbols, by halving its length."""
    good, bad = np.zeros(len(at), dtype=np.int64), most.astype(np.int64) + 1
    low = np.zeros(len(at), dtype=np.int64)
    high = np.full(len(at), len(index.suffixes), dtype=np.int64)
    while True:
        open_ones = np.flatnonzero(bad - good > 1)
        if not len(open_ones):
            return low, high, good.astype(np.int32)
        tried = (good[open_ones] + bad[open_ones]) // 2
        a = np.zeros(len(open_ones), dtype=np.int64)
        b = np.full(len(open_ones), len(index.suffixes), dtype=np.int64)
        for back in range(int(tried.max()) - 1, -1, -1):
            now = np.flatnonzero((tried > back) & (b > a))
            if len(now):
                symbol = symbols[at[open_ones[now]] + back]
                a[now], b[now] = index.extend(a[now], b[now], symbol)
        found = b > a
        good[open_ones[found]] = tried[found]
        low[open_ones[found]], high[open_ones[found]] = a[found], b[found]
        bad[open_ones[~found]] = tried[~found]
