"""Tries in flat arrays, for dictionaries and pattern rules that are held by every task.

Nodes are numbered level by level, the children of a node next to each other and in order of their
character, so a node is nothing but the number of its first child and the character that leads to it:
six bytes (eight with more than 65,000 different characters). Texts are walked side by side, one
character of each at a time, so a step is a few array operations for all texts of a batch.

`PatternTrie` adds fail links (Aho and Corasick): the node of the longest proper suffix that is in the
trie. A text is read once, whatever the number and lengths of the patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LABEL_BITS = 21  # a character's number in a key of (parent, character)
NO_RULE = np.iinfo(np.int32).max
# Texts are cut into windows of this many characters (more for long patterns) to look for patterns.
WINDOW = 256


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in one array, and where each text begins and ends."""
    texts = texts.cast(pa.large_string())
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = memoryview(data)[at[0]:at[-1]] if data is not None and len(texts) else b""
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    return points, np.append(0, np.cumsum(lengths))


@dataclass(frozen=True)
class Trie:
    """Children of node n are the nodes first[n] to first[n + 1] - 1; node 0 is the root."""

    first: np.ndarray
    label: np.ndarray
    chars: np.ndarray

    @property
    def nodes(self) -> int:
        return len(self.label)

    @property
    def nbytes(self) -> int:
        return self.first.nbytes + self.label.nbytes + self.chars.nbytes

    def labels_of(self, points: np.ndarray) -> np.ndarray:
        """Characters as labels; 0 for what is in no word."""
        if not len(self.chars):
            return np.zeros(len(points), np.int64)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, at + 1, 0)

    def children(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node along a label, 0 if there is none: binary searches side by side."""
        low, high = self.first[node].astype(np.int64), self.first[node + 1].astype(np.int64)
        end = high.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = self.label[middle] < label[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
            todo = todo[low[todo] < high[todo]]
        there = np.minimum(low, self.nodes - 1)
        return np.where((low < end) & (self.label[there] == label), there, 0)


def build(points: np.ndarray, bounds: np.ndarray) -> tuple[Trie, np.ndarray]:
    """The trie of some words (as `code_points`), and the node at which each of them ends."""
    length = np.diff(bounds)
    chars = np.unique(points)
    number = np.searchsorted(chars, points) + 1
    node = np.zeros(len(length), np.int64)
    labels, parents, total = [np.zeros(1, np.int64)], [], 1
    open_, depth = np.flatnonzero(length > 0), 0
    while len(open_):
        key = node[open_] << _LABEL_BITS | number[bounds[open_] + depth]
        new, which = np.unique(key, return_inverse=True)
        labels.append(new & ((1 << _LABEL_BITS) - 1))
        parents.append(new >> _LABEL_BITS)
        node[open_] = total + which
        total, depth = total + len(new), depth + 1
        open_ = open_[length[open_] > depth]
    degree = np.bincount(np.concatenate(parents), minlength=total) if parents else np.zeros(total, np.int64)
    kind = np.uint16 if len(chars) < 1 << 16 else np.uint32
    first = np.append(1, 1 + np.cumsum(degree))
    return Trie(first.astype(np.uint32), np.concatenate(labels).astype(kind), chars), node


def _side_by_side(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from the longest on, and how many of them have a first, second, ... character."""
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    return order, len(length) - np.searchsorted(length[order][::-1], np.arange(longest), "right")


@dataclass(frozen=True)
class DictionaryTrie:
    """Words by path, each with further values (an Arrow table in the order of `ends`)."""

    trie: Trie
    ends: np.ndarray
    values: pa.Table

    @classmethod
    def of(cls, paths: pa.Array, values: pa.Table) -> DictionaryTrie:
        """From distinct paths."""
        trie, node = build(*code_points(paths))
        order = np.argsort(node)
        return cls(trie, node[order].astype(np.uint32), values.take(pa.array(order)).combine_chunks())

    def walked(self, texts: pa.Array) -> np.ndarray:
        """The node that each text reaches: characters that continue no word are skipped."""
        points, bounds = code_points(texts)
        label = self.trie.labels_of(points)
        order, counts = _side_by_side(np.diff(bounds))
        state, start = np.zeros(len(order), np.int64), bounds[:-1][order]
        for step, n in enumerate(counts.tolist()):
            child = self.trie.children(state[:n], label[start[:n] + step])
            state[:n] = np.where(child > 0, child, state[:n])
        out = np.empty_like(state)
        out[order] = state
        return out

    def followed(self, node: np.ndarray, text: str) -> np.ndarray:
        """The nodes that lie a whole text below; 0 where there is none."""
        alive = np.ones(len(node), bool)
        for label in self.trie.labels_of(np.array([ord(c) for c in text], np.uint32)).tolist():
            node = self.trie.children(node, np.full(len(node), label))
            alive &= node > 0
        return np.where(alive, node, 0)

    def entries(self, node: np.ndarray) -> np.ndarray:
        """The rows of `values` that end at each node, -1 for none."""
        if not len(self.ends):
            return np.full(len(node), -1)
        at = np.minimum(np.searchsorted(self.ends, node), len(self.ends) - 1)
        return np.where(self.ends[at] == node, at, -1)


@dataclass(frozen=True)
class PatternTrie:
    """Patterns with fail links; `best` is the smallest rank among the patterns that end at a node."""

    trie: Trie
    fail: np.ndarray
    best: np.ndarray
    longest: int

    @classmethod
    def of(cls, patterns: pa.Array) -> PatternTrie:
        """From distinct patterns; their places are their ranks."""
        points, bounds = code_points(patterns)
        trie, node = build(points, bounds)
        own = np.full(trie.nodes, NO_RULE, np.int32)
        own[node] = np.arange(len(node))
        out = cls(trie, np.zeros(trie.nodes, np.uint32), own, int(np.diff(bounds).max(initial=0)))
        # level by level: a fail link leads to a level above
        low, high = 0, 1
        while low < high:
            children = np.arange(trie.first[low], trie.first[high])
            if len(children) and low:
                parent = np.repeat(np.arange(low, high), np.diff(trie.first[low:high + 1].astype(np.int64)))
                out.fail[children] = out.stepped(out.fail[parent].astype(np.int64), trie.label[children].astype(np.int64))
            own[children] = np.minimum(own[children], own[out.fail[children]])
            low, high = high, high + len(children)
        return out

    @property
    def nbytes(self) -> int:
        return self.trie.nbytes + self.fail.nbytes + self.best.nbytes

    def stepped(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The next state of each text: the longest suffix of what was read that is in the trie."""
        out = self.trie.children(state, label)
        todo = np.flatnonzero((out == 0) & (state > 0) & (label > 0))
        state = state[todo]
        while len(todo):
            state = self.fail[state].astype(np.int64)
            out[todo] = self.trie.children(state, label[todo])
            more = (out[todo] == 0) & (state > 0)
            todo, state = todo[more], state[more]
        return out

    def first_ranks(self, texts: pa.Array) -> np.ndarray:
        """The smallest rank of a pattern that each text contains, NO_RULE if it contains none.

        A long text is read as many windows, which overlap by the longest pattern but one character.
        """
        points, bounds = code_points(texts)
        label = self.trie.labels_of(points)
        size, overlap = max(WINDOW, 4 * self.longest), max(0, self.longest - 1)
        length = np.diff(bounds)
        windows = np.maximum(1, -(-(length - overlap) // (size - overlap)))
        owner = np.repeat(np.arange(len(length)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = bounds[:-1][owner] + nth * (size - overlap)
        order, counts = _side_by_side(np.minimum(size, bounds[1:][owner] - start))
        start, owner = start[order], owner[order]
        state, found = np.zeros(len(order), np.int64), np.full(len(order), self.best[0], np.int32)
        for step, n in enumerate(counts.tolist()):
            state[:n] = self.stepped(state[:n], label[start[:n] + step])
            found[:n] = np.minimum(found[:n], self.best[state[:n]])
        out = np.full(len(length), NO_RULE, np.int32)
        np.minimum.at(out, owner, found)
        return out
