"""A compressed full-text index over numbers: a wavelet matrix of the Burrows-Wheeler transform.

The text is many passages of symbols 1, 2, ..., each closed by 0. Suffixes are ordered by their
first `depth` symbols, which is all that a search for patterns up to that length needs.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before every block of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """How often a symbol occurs before a place, in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        for level in range(self.bits - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            self.levels.append((BitVector(one), int(len(one) - np.count_nonzero(one))))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.start = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (vector, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = vector.ones(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.start[symbol]


def prefix_ranks(text: np.ndarray, alphabet: int, depth: int) -> np.ndarray:
    """For every place the rank of the `depth` symbols that begin there, by prefix doubling.

    As many symbols as fit into one number are ranked at once to begin with.
    """
    bits = max(1, int(alphabet).bit_length())
    known = max(1, min(depth, 62 // bits))
    rank = text.astype(np.int64)
    key = rank.copy()
    for step in range(1, known):
        key <<= bits
        key[:-step or None] |= rank[step:] + 1
    rank = np.unique(key, return_inverse=True)[1]
    while known < depth and rank.max(initial=0) + 1 < len(text):
        step = min(known, depth - known)
        following = np.zeros_like(rank)
        following[:-step or None] = rank[step:] + 1
        rank = np.unique(rank * (len(text) + 1) + following, return_inverse=True)[1]
        known += step
    return rank


class FMIndex:
    """Backward search for patterns of up to `depth` symbols and one more."""

    def __init__(self, text: np.ndarray, alphabet: int, depth: int):
        rank = prefix_ranks(text, alphabet, depth)
        order = np.argsort(rank, kind="stable")
        self.size, self.depth = len(text), depth
        self.transform = WaveletMatrix(text[order - 1], alphabet)
        self.smaller = np.zeros(alphabet, np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet)[:-1], out=self.smaller[1:])
        # suffixes that share `depth` symbols are a group
        sorted_rank = rank[order]
        new = np.ones(len(text), bool)
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        self.groups = BitVector(new)
        self.group_start = np.r_[np.flatnonzero(new), len(text)]

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with a symbol followed by those of an interval."""
        n = len(symbol)
        rank = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.smaller[symbol]
        return base + rank[:n], base + rank[n:]

    def shortened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes that share `depth` symbols with suffix `low`."""
        group = self.groups.ones(low + 1) - 1
        return self.group_start[group], self.group_start[group + 1]

    def matching_counts(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every passage, how often the `depth` symbols from each of its places occur.

        Passage i is symbols[first[i]:first[i + 1]]. Returns the counts of all passages one after
        the other, and where those of each passage begin.

        All passages are streamed from their ends at once, one symbol per step. Once `depth`
        symbols match, every further symbol on the left drops one on the right, so the search
        never starts anew. Passages are part of the indexed text, so no search fails.
        """
        length = np.diff(first)
        windows = np.maximum(length - self.depth + 1, 0)
        places = np.r_[0, np.cumsum(windows)]
        counts = np.zeros(int(places[-1]), np.int64)
        order = np.argsort(-length, kind="stable")
        end, begin, left = first[1:][order], places[:-1][order], length[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.size)
        for step in range(1, int(left[0]) + 1 if len(left) else 0):
            active = int(np.searchsorted(-left, -step, "right"))
            low, high = self.extended(symbols[end[:active] - step], low[:active], high[:active])
            if step > self.depth:
                low, high = self.shortened(low)
            if step >= self.depth:
                counts[begin[:active] + left[:active] - step] = high - low
        return counts, places
