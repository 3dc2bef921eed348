"""A compressed full-text index over sequences of words, with searches for many patterns at once.

The index is the Burrows-Wheeler transform of all sequences in a wavelet matrix: one bit per level and
position, with a running count every 64 bits. A search goes backward: from the range of suffixes that
begin with a string, the ranks at the range's two ends give the range of the string with one more word
in front. Sequences are ended by marks that differ from each other and that no search asks for, so that
no match runs over an end.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling of the compared length.

    Symbol 0 ends a sequence; it comes before all others, and earlier ones come before later ones. The
    last symbol must be 0.
    """
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + (int(ends.sum()) - 1)).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    size = 1
    while True:
        ordered = rank[order]
        tied = np.empty(n, bool)
        tied[0], tied[1:] = False, ordered[1:] == ordered[:-1]
        # A group's rank is the place of its first member, so groups can be refined one by one.
        first = np.maximum.accumulate(np.where(tied, 0, np.arange(n)))
        rank[order] = first
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        # A tied suffix has no end within its first `size` symbols, so it goes on inside the array.
        group = order[at]
        key = first[at] * n + rank[group + size]
        by = np.argsort(key, kind="stable")
        order[at] = group[by]
        spread = np.arange(n)
        spread[at] = n + np.cumsum(np.concatenate(([True], np.diff(key[by]) != 0)))
        rank[order] = spread
        size *= 2


class WaveletMatrix:
    """Symbols in one bit per level, counted every 64 bits; counts a symbol up to any place."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        n = len(symbols)
        cells = n // 64 + 1
        self.bits = np.zeros((self.levels, cells), np.uint64)
        self.counts = np.zeros((self.levels, cells), np.uint32)
        self.zeros = np.zeros(self.levels, np.int64)
        for level in range(self.levels):
            ones = (symbols >> (self.levels - 1 - level)) & 1 == 1
            packed = np.zeros(cells * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            self.bits[level] = packed.view(np.uint64)
            self.counts[level, 1:] = np.cumsum(np.bitwise_count(self.bits[level, :-1]), dtype=np.uint32)
            self.zeros[level] = n - int(ones.sum())
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the first `places` symbols end among those equal to `symbols`, in the order of the last level."""
        places = places.astype(np.int64)
        for level in range(self.levels):
            bits, counts = self.bits[level], self.counts[level]
            cell = places >> 6
            below = bits[cell] & ((_ONE << (places & 63).astype(np.uint64)) - _ONE)
            ones = counts[cell].astype(np.int64) + np.bitwise_count(below)
            places = np.where((symbols >> (self.levels - 1 - level)) & 1 == 1, self.zeros[level] + ones, places - ones)
        return places


class FmIndex:
    """Sequences of symbols from 1 on, each followed by a 0, as one array `text`; `weight` of every place counts its matches."""

    def __init__(self, text: np.ndarray, weight: np.ndarray):
        order = suffix_order(text)
        self.size, n_symbols = len(text), int(text.max()) + 1
        starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.starts = starts
        self.matrix = WaveletMatrix(text[order - 1], n_symbols)
        symbols = np.arange(n_symbols)
        # From a place in the last level to a place among the suffixes that begin with the symbol.
        self.shift = starts[:-1] - self.matrix.descend(symbols, np.zeros(n_symbols, np.int64))
        self.weight = np.concatenate(([0], np.cumsum(weight[order])))

    def widen(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with a symbol followed by what the ranges `low` to `high` begin with."""
        both = self.matrix.descend(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        both += np.concatenate((self.shift[symbols], self.shift[symbols]))
        return both[: len(low)], both[len(low) :]

    def reach(self, text: np.ndarray, ends: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Matching statistics, from right to left: the first place p, not below `least`, for which text[p:end + 1] weighs 2 or more.

        One place after the end if not even the word there does.
        """
        at = ends.copy()
        first = text[at]
        low, high = self.starts[first], self.starts[first + 1]
        out = ends + 1
        lanes = np.arange(len(ends))
        while len(lanes):
            good = self.weight[high] - self.weight[low] >= 2
            out[lanes[good]] = at[good]
            on = good & (at > least[lanes])
            lanes, at, low, high = lanes[on], at[on] - 1, low[on], high[on]
            low, high = self.widen(text[at], low, high)
        return out


def repeated_windows(text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of `width` symbols that occur again: sequence, first window, end of the run.

    `begins` and `lengths` say where the sequences lie in `text`. A search from the end of a window either
    reaches back to all windows in question, or fails at a place; then no window that holds that place and
    the end occurs again, all windows between the place and the end do, and those to either side are
    searched on, halving what is left.
    """
    index = FmIndex(text, weight)
    found = []
    lane = np.flatnonzero(lengths >= width)
    low, high = np.zeros(len(lane), np.int64), lengths[lane] - width
    last = True
    while len(lane):
        mid = high if last else (low + high + 1) // 2
        begin = begins[lane]
        reached = index.reach(text, begin + mid + width - 1, begin + low) - begin
        hit = reached <= mid
        found.append((lane[hit], reached[hit], mid[hit] + 1))
        # What failed is the place before `reached`. Windows up to it that end at or after the search's end don't occur again.
        left = np.where(hit, np.minimum(reached - 1, mid - 1), mid - 1)
        right = np.where(hit, mid + 1, reached)
        more_left, more_right = low <= left, right <= high
        # A left part that a search was stopped at by its own bound has nothing left.
        lane, low, high = (
            np.concatenate((lane[more_left], lane[more_right])), np.concatenate((low[more_left], right[more_right])),
            np.concatenate((left[more_left], high[more_right])),
        )
        last = False
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
