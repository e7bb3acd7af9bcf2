"""An FM-index over sequences of words: bit-packed wavelet matrix, backward search for many patterns at a time."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(ones[:-1], dtype=np.int64))).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of many sequences of symbols 1, 2, ..., each with a weight, for patterns of up to `depth` symbols.

    Suffixes are ordered by their first `depth` symbols (prefix doubling), which backward search for such
    patterns is exact on. The Burrows-Wheeler transform is held as a wavelet matrix: one packed bit vector
    for each bit of a symbol. weight(lo, hi) sums the weights of the sequences that the suffixes are in.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, weights: np.ndarray, depth: int):
        n = len(symbols) + len(lengths)
        first = np.cumsum(lengths + 1) - (lengths + 1)
        text = np.zeros(n, np.int64)  # a 0 after each sequence
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)] = symbols
        self.text, self.first, self.size = text, first, n
        order = self._suffixes(text, depth)
        last = text[order - 1]
        top = int(text.max()) + 1
        counts = np.bincount(text, minlength=top)
        self.levels: list[tuple[int, Bits, int]] = []
        at = np.zeros(top, np.int64)  # where position 0 is led for each symbol
        symbol = np.arange(top)
        for shift in reversed(range(max(1, (top - 1).bit_length()))):
            bit = (last >> shift) & 1
            bits, zeros = Bits(bit), int(n - bit.sum())
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
            self.levels.append((shift, bits, zeros))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        self.base = np.cumsum(counts) - counts - at
        held = weights[owner[order]]
        self.weights = np.concatenate(([0], np.cumsum(held)))

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        n, width, rank = len(text), 1, text
        order = np.argsort(rank, kind="stable")
        while width < depth:
            key = rank << 32
            key[:-width] |= rank[width:] if width < n else 0
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            rank, width = new, width * 2
            if rank[order[-1]] == n - 1:
                break
        return order

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes for symbol + pattern, from those for pattern."""
        k = len(symbol)
        both = np.concatenate((lo, hi))
        for shift, bits, zeros in self.levels:
            ones = bits.rank(both)
            right = ((symbol >> shift) & 1).astype(bool)
            right = np.concatenate((right, right))
            both = np.where(right, ones + zeros, both - ones)
        base = self.base[symbol]
        return both[:k] + base, both[k:] + base

    def repeated(self, lengths: np.ndarray, window: int, least: int = 2) -> np.ndarray:
        """For each indexed sequence (of up to window + 62 symbols) a mask of its windows that occur `least` times.

        All sequences are streamed from right to left at once. With the end E of what is looked for fixed, the
        match ending there is extended to the left while it still occurs often enough; its length is the
        matching statistic at E. If it spans a window, those inside are marked. The symbol p that ended it
        rules out every window that holds p and reaches E, so the next end is the smaller of E - 1 and
        p + window; ends that this skips have nothing new.
        """
        mask = np.zeros(len(lengths), np.int64)
        live = np.flatnonzero(lengths >= window)
        end = lengths[live].copy()
        at, lo, hi = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), self.size)
        while len(live):
            got_lo, got_hi = self.extend(self.text[self.first[live] + at - 1], lo, hi)
            often = self.weights[got_hi] - self.weights[got_lo] >= least
            at = at - often
            lo, hi = np.where(often, got_lo, 0), np.where(often, got_hi, self.size)
            done = np.flatnonzero(~often | (at == 0))
            if not len(done):
                continue
            begin, stop = at[done], end[done]
            long = stop - begin >= window
            mask[live[done[long]]] |= ((1 << (stop - window + 1 - begin)[long]) - 1) << begin[long]
            after = np.minimum(stop - 1, begin - 1 + window)
            after[begin == 0] = 0
            end[done], at[done], lo[done], hi[done] = after, after, 0, self.size
            keep = end >= window
            if not keep.all():
                live, end, at, lo, hi = live[keep], end[keep], at[keep], lo[keep], hi[keep]
        return mask
