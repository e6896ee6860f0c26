"""Monotone sequences in Elias-Fano form, and a trie of n-grams made of them.

Every level is a flat array, so a trie can be written to a file and used from a memory map.
"""

from __future__ import annotations

import json
import mmap
import tempfile

import numpy as np

# Probabilities are stored as log10 in 16 bits, rounded down.
CODES, LOWEST = 65_535, -12.0


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 stands for none."""
    with np.errstate(divide="ignore"):
        scaled = np.floor((np.log10(p) - LOWEST) / -LOWEST * (CODES - 1)) + 1
    return np.where(p > 0, np.clip(scaled, 1, CODES), 0).astype(np.uint16)


def unquantised(codes: np.ndarray) -> np.ndarray:
    value = 10.0 ** ((codes.astype(np.float64) - 1) / (CODES - 1) * -LOWEST + LOWEST)
    return np.where(codes > 0, value, 0.0)


# Masks that count ones within a 64-bit number, and the place of the r-th one of every byte.
_ALTERNATE, _PAIRS, _NIBBLES = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))
_BYTES, _HIGHEST, _BYTE = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0xFF)
_IN_BYTE = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[:8] for byte in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, before: np.ndarray, width: int, size: int):
        self.low, self.high, self.before, self.width, self.size = low, high, before, width, size

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.empty((n, width), bool)
        for k in range(width):
            bits[:, k] = values >> np.uint64(k) & np.uint64(1)
        bits = bits.ravel()
        high = np.zeros((top >> width) + n + 1, bool)
        high[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = True
        words = _packed(high)
        return cls(_packed(bits), words, np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.int64), width, n)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = self._select(i) - i
        if not self.width:
            return high
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        low = self.low[word] >> shift
        # shifting by 64 is undefined, so the next word is shifted in two steps
        low |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return high << self.width | (low & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _select(self, i: np.ndarray) -> np.ndarray:
        """The place of one number i in the unary bits."""
        word = np.searchsorted(self.before, i, "right") - 1
        rest, bits = (i - self.before[word]).astype(np.uint64), self.high[word]
        # ones up to and with each byte, side by side in one number
        sums = bits - (bits >> np.uint64(1) & _ALTERNATE)
        sums = (sums & _PAIRS) + (sums >> np.uint64(2) & _PAIRS)
        sums = (sums + (sums >> np.uint64(4)) & _NIBBLES) * _BYTES
        # bytes that end before the wanted one, counted by their highest bits
        passed = np.bitwise_count((rest * _BYTES | _HIGHEST) - sums & _HIGHEST).astype(np.uint64) << np.uint64(3)
        rest -= sums << np.uint64(8) >> passed & _BYTE
        return (word << 6) + passed.astype(np.int64) + _IN_BYTE[bits >> passed & _BYTE, rest]

    def search(self, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Successor search: in [first, last), the first place with at least `value`."""
        low, high = first.copy(), last.copy()
        for _ in range(int((last - first).max(initial=0)).bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            less = self[middle] < value[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "before": self.before, "shape": np.array([self.width, self.size])}

    @classmethod
    def from_arrays(cls, own: dict[str, np.ndarray]) -> EliasFano:
        width, size = own["shape"].tolist()
        return cls(own["low"], own["high"], own["before"], width, size)


def _packed(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    words = np.zeros(len(bits) // 64 + 2, np.uint64)
    words.view(np.uint8)[:len(packed)] = packed
    return words


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and the run of every place."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Trie:
    """Discounted probabilities of the successors of one- and two-word contexts.

    Level 1 holds words, each with its successors (level 2) and the words before it (the
    two-word contexts). Successors of a two-word context (level 3) are stored relative to the
    successors of its last word: as places in that list, which are small numbers.
    Lists of one level follow each other; a list's values are raised by the list's number times
    the range, which makes the level one monotone sequence.
    """

    SEQUENCES = ("words", "follow_at", "follow", "context_at", "context", "third_at", "third")
    VALUES = ("follow_p", "word_rest", "third_p", "context_rest")
    RANGE = 1 << 32

    def __init__(self, sequences: dict[str, EliasFano], values: dict[str, np.ndarray]):
        self.sequences, self.values = sequences, values

    @classmethod
    def build(cls, before: np.ndarray, word: np.ndarray, after: np.ndarray, count: np.ndarray,
              none: int, rare: int, least: int, discount: float) -> Trie:
        """From counted triples (word before, context word, successor), in any order, all different.

        `none` before means no two-word context; `rare` as a successor only counts for the totals
        of its context. N-grams seen fewer than `least` times are left to the rest of their context.
        """
        order = np.lexsort((after, before, word))
        before, word, after, count = before[order], word[order], after[order], count[order]
        words, w_at = np.unique(word, return_inverse=True)
        w_total = np.bincount(w_at, count, len(words))
        # level 2
        pair, p_at = np.unique(w_at * cls.RANGE + after, return_inverse=True)
        p_count = np.bincount(p_at, count, len(pair))
        p_keep = (p_count >= least) & (pair % cls.RANGE != rare)
        pair, p_count = pair[p_keep], p_count[p_keep]
        p_word = pair // cls.RANGE
        p_value = (p_count - discount) / w_total[p_word]
        follow_at = np.searchsorted(p_word, np.arange(len(words) + 1))
        # two-word contexts and level 3
        two = before != none
        ctx, c_at = np.unique((w_at * cls.RANGE + before)[two], return_inverse=True)
        c_total = np.bincount(c_at, count[two], len(ctx))
        keep = (count[two] >= least) & (after[two] != rare)
        t_ctx, t_count = c_at[keep], count[two][keep]
        place = np.searchsorted(pair, w_at[two][keep] * cls.RANGE + after[two][keep]) - follow_at[w_at[two][keep]]
        t_value = (t_count - discount) / c_total[t_ctx]
        used = np.unique(t_ctx)  # contexts without a kept successor leave everything to level 2
        t_ctx = np.searchsorted(used, t_ctx)
        ctx = ctx[used]
        c_word = ctx // cls.RANGE
        sequences = {
            "words": words, "follow_at": follow_at, "follow": pair,
            "context_at": np.searchsorted(c_word, np.arange(len(words) + 1)), "context": ctx,
            "third_at": np.searchsorted(t_ctx, np.arange(len(used) + 1)), "third": t_ctx * cls.RANGE + place,
        }
        values = {
            "follow_p": quantised(p_value), "word_rest": quantised(1 - np.bincount(p_word, p_value, len(words))),
            "third_p": quantised(t_value), "context_rest": quantised(1 - np.bincount(t_ctx, t_value, len(used))),
        }
        return cls({k: EliasFano.of(v) for k, v in sequences.items()}, values)

    def _place(
        self, level: str, first: np.ndarray, last: np.ndarray, list_number: np.ndarray, value: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Search a value in a numbered list, [first, last) of a level: its place, and whether it is there."""
        sequence = self.sequences[level]
        wanted = list_number * self.RANGE + value
        place = sequence.search(first, last, wanted)
        there = place < last
        there[there] = sequence[place[there]] == wanted[there]
        return place, there

    def query(self, before: np.ndarray, word: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) such that a + b * P(successor alone) is the probability of each successor."""
        n = len(word)
        a, b = np.zeros(n), np.ones(n)
        words = self.sequences["words"]
        if not n or not words.size:
            return a, b
        # neighbouring questions share their word and mostly their context: each is searched once
        head, own = _runs(word)
        w = words.search(np.zeros(len(head), np.int64), np.full(len(head), words.size), word[head])
        known = w < words.size
        known[known] = words[w[known]] == word[head][known]
        first, last = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        first[known], last[known] = self.sequences["follow_at"][w[known]], self.sequences["follow_at"][w[known] + 1]
        rest = np.ones(len(head))
        rest[known] = unquantised(self.values["word_rest"][w[known]])
        b[:] = rest[own]
        k = np.flatnonzero(known[own])
        place, there = self._place("follow", first[own[k]], last[own[k]], w[own[k]], after[k])
        a[k[there]] = unquantised(self.values["follow_p"][place[there]])
        # two-word contexts
        ctx, at = _runs(word[k], before[k])
        list_number = w[own[k[ctx]]]
        bounds = self.sequences["context_at"]
        c, has = self._place("context", bounds[list_number], bounds[list_number + 1], list_number, before[k[ctx]])
        rest = np.ones(len(ctx))
        rest[has] = unquantised(self.values["context_rest"][c[has]])
        a[k] *= rest[at]
        b[k] *= rest[at]
        both = has[at] & there
        number, relative = c[at[both]], place[both] - first[own[k[both]]]
        low, high = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.int64)
        low[has], high[has] = self.sequences["third_at"][c[has]], self.sequences["third_at"][c[has] + 1]
        t, found = self._place("third", low[at[both]], high[at[both]], number, relative)
        a[k[both][found]] += unquantised(self.values["third_p"][t[found]])
        return a, b

    def to_bytes(self) -> bytes:
        """All levels, with a directory in front."""
        flat = {f"{k}.{part}": array for k, s in self.sequences.items() for part, array in s.arrays().items()} | self.values
        directory, at = {}, 0
        for name, array in flat.items():
            directory[name] = (str(array.dtype), at, len(array))
            at += -(-array.nbytes // 8) * 8
        head = json.dumps(directory).encode()
        head += b" " * (-(len(head) + 8) % 8)
        out = [len(head).to_bytes(8, "little"), head]
        for array in flat.values():
            out += [array.tobytes(), b"\0" * (-array.nbytes % 8)]
        return b"".join(out)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie in a memory map of a temporary file, which goes with the map."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(view[:8], "little")
        flat = {
            name: np.frombuffer(view, np.dtype(kind), n, 8 + size + at) for name, (kind, at, n) in json.loads(view[8:8 + size]).items()
        }
        parts = ("low", "high", "before", "shape")
        sequences = {k: EliasFano.from_arrays({p: flat[f"{k}.{p}"] for p in parts}) for k in cls.SEQUENCES}
        return cls(sequences, {k: flat[k] for k in cls.VALUES})
