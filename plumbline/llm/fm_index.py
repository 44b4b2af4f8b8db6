"""A compressed FM-index of a sequence of integers: a wavelet matrix over the transform, searched backwards."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of symbols in an array of integers below 2**bits: one packed bit row a level, with a count every 64 bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.rows, self.sums, self.zeros = bits, [], [], []
        values = values.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            row = np.packbits(padded, bitorder="little").view(np.uint64)
            self.rows.append(row)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(row).astype(np.int64))[:-1]]))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position at lands after all levels, on the path of its symbol."""
        for k, (row, sums, zeros) in enumerate(zip(self.rows, self.sums, self.zeros, strict=True)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = sums[word] + np.bitwise_count(row[word] & mask)
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of text (integers from 0) for patterns of up to depth symbols.

    Suffixes are ordered by their first depth symbols, then by place: the interval of any pattern that short is the one
    of the full suffix order, and that of a pattern of depth symbols begins with its first occurrence.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        rank, held = np.unique(text, return_inverse=True)[1].astype(np.int64), 1

        def join(shift: int) -> np.ndarray:
            after = np.zeros(n, np.int64)
            after[: n - shift if n > shift else 0] = rank[shift:] + 1
            return np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)

        while held < depth:
            step = min(held, depth - held)
            rank = join(step)
            held += step
        self.order = np.argsort(rank, kind="stable")
        bwt = text[self.order - 1]
        size = int(text.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.matrix = WaveletMatrix(bwt, max(1, (size - 1).bit_length()))
        self.base = self.matrix.descend(np.arange(size), np.zeros(size, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, from those of the patterns: one step of backward search."""
        both = self.matrix.descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        shift = self.before[symbols] - self.base[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def matching(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every end in text (its last symbol included): how many symbols up to depth, read backwards from there,
        also occur elsewhere in the index, and the first occurrence of those. The texts are part of the index, so an
        interval of one row is the text itself and ends the search.
        """
        length = np.zeros(len(ends), np.int64)
        first = np.full(len(ends), -1, np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.order), np.int64)
        for step in range(self.depth):
            low, high = self.extend(text[ends[live] - step], low, high)
            more = high - low > 1
            live, low, high = live[more], low[more], high[more]
            if not len(live):
                break
            length[live] = step + 1
        first[live] = self.order[low]
        return length, first
