"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton recognises every word sequence of the items. Training texts are streamed through
it; it tracks the length of the longest match that ends at each word. A match of at least WINDOW
words, or of a whole shorter item, is an occurrence, and its words are hit.

Only stretches of a text in which every two neighbouring words are neighbours in some item can
hold a match of two words; the rest is passed over by a vectorised look-up, so the automaton
sees few words. Words are compared by their bytes in the end.

The items of a benchmark are measured. Up to `shard_words` words make one automaton, which is
broadcast; larger benchmarks are cut into several automata by item, one pass over the texts for
each. The rows then get written numbers, and the hits of all passes are united by these before anything
is judged or cut.

Defined cases: missing texts have no words, items without words no windows. Repeated rows repeat
their result; items that share an item_id count once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.shared import written

from . import tokens as tk

WINDOW = 10
# Bytes of items in one automaton.
SHARD_BYTES = 16 << 20


@dataclass
class Automaton:
    """States of the generalised suffix automaton over word numbers.

    `owners[state]` holds the items whose windows end in this state.
    """

    window: int
    words: dict[bytes, int] = field(default_factory=dict)
    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    owners: dict[int, set[str]] = field(default_factory=dict)
    shorter: dict[int, list[tuple[int, set[str]]]] = field(default_factory=dict)
    least: int = 0
    marks: np.ndarray | None = None
    pairs: np.ndarray | None = None

    def extend(self, last: int, c: int) -> int:
        moves, length, link = self.moves, self.length, self.link
        known = moves[last].get(c)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, c, known)
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        moves, link = self.moves, self.link
        clone = len(moves)
        moves.append(dict(moves[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = clone
            p = link[p]
        return clone

    def run(self, sequence: list[int | None]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, length, items) of every window that occurs in a sequence of word numbers."""
        moves, length, link, window = self.moves, self.length, self.link, self.window
        state = matched = 0
        for end, c in enumerate(sequence, 1):
            while state and c not in moves[state]:
                state = link[state]
                matched = length[state]
            to = moves[state].get(c)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                if own := self.owners.get(at):
                    yield end, window, own
            if self.shorter:
                at, left = state, matched
                while at > 0:
                    for size, own in self.shorter.get(at, ()):
                        if size <= left:
                            yield end, size, own
                    at = link[at]
                    left = length[at]


def split_words(text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    chunk = tk.lowered(next(tk.chunks(pa.array([text], pa.string()))))
    found = tk.find_words(chunk, tk.ALPHANUMERIC)
    return found.start, found.end, [chunk.data[s:e].tobytes() for s, e in zip(found.start.tolist(), found.end.tolist(), strict=True)]


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> Automaton:
    """The automaton of (item, text) rows."""
    auto = Automaton(window)
    sequences = []
    for name, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
        own = [auto.words.setdefault(w, len(auto.words)) for w in split_words(text)[2]]
        if own:
            sequences.append((name, own))
            last = 0
            for c in own:
                last = auto.extend(last, c)
    for name, own in sequences:
        size = min(window, len(own))
        for end in range(size, len(own) + 1):
            state = 0
            for c in own[end - size:end]:
                state = auto.moves[state][c]
            if size == window:
                auto.owners.setdefault(state, set()).add(name)
            else:
                known = auto.shorter.setdefault(state, [])
                for length, names in known:
                    if length == size:
                        names.add(name)
                        break
                else:
                    known.append((size, {name}))
    auto.least = min((min(window, len(own)) for _, own in sequences), default=0)
    texts = list(auto.words)
    chunk = next(tk.chunks(pa.array([" ".join(w.decode() for w in texts)])))
    number = tk.fingerprints(chunk.data, tk.find_words(chunk, tk.ALPHANUMERIC))
    auto.marks = np.unique(number)
    pairs = [np.array(own, np.int64) for _, own in sequences if len(own) > 1]
    auto.pairs = np.unique(np.concatenate([_pair(number[p[:-1]], number[p[1:]]) for p in pairs])) if pairs else np.empty(0, np.uint64)
    return auto


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return tk.mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _bits(marks: np.ndarray) -> np.ndarray:
    """A filter of 2**22 places for a set of numbers."""
    table = np.zeros(1 << 22, bool)
    table[(marks >> np.uint64(42)).astype(np.int64)] = True
    return table


def _member(values: np.ndarray, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = bits[(values >> np.uint64(42)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(at) and len(known):
        place = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
        out[at] = known[place] == values[at]
    return out


class Streamer:
    """Streams chunks of texts through an automaton."""

    def __init__(self, auto: Automaton):
        self.auto = auto
        self.word_bits, self.pair_bits = _bits(auto.marks), _bits(auto.pairs)

    def stretches(self, words: tk.Words, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words, within a row, that can hold an occurrence."""
        if self.auto.least == 1:
            alive = _member(marks, self.auto.marks, self.word_bits)
            linked = alive[:-1] & alive[1:]
        else:
            linked = _member(_pair(marks[:-1], marks[1:]), self.auto.pairs, self.pair_bits)
            alive = np.zeros(len(marks), bool)
            alive[:-1] |= linked
            alive[1:] |= linked
        row_start = words.first[(words.first > 0) & (words.first < len(marks))]
        linked[row_start - 1] = False
        begins = alive.copy()
        begins[1:] &= ~linked
        ends = alive.copy()
        ends[:-1] &= ~linked
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = b - a >= self.auto.least
        return a[long], b[long]

    def hits(self, chunk: tk.Chunk) -> tuple[tk.Words, np.ndarray, dict[int, set[str]]]:
        """Words of a lower-cased chunk, which of them are hit, and the items found per row."""
        words = tk.find_words(chunk, tk.ALPHANUMERIC)
        hit = np.zeros(len(words), bool)
        items: dict[int, set[str]] = {}
        if self.auto.least and len(words):
            marks = tk.fingerprints(chunk.data, words)
            data, number = chunk.data, self.auto.words.get
            for a, b in zip(*self.stretches(words, marks), strict=True):
                sequence = [number(data[s:e].tobytes()) for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
                own: set[str] | None = None
                for end, size, names in self.auto.run(sequence):
                    hit[a + end - size:a + end] = True
                    if own is None:
                        own = items.setdefault(int(np.searchsorted(words.first, a, "right")) - 1, set())
                    own |= names
        return words, hit, items


def shards(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """The items in groups of at most about `shard_bytes`: their number, and each collected when its turn comes.

    One group is the normal case. The number of groups follows the measured size.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0))).first()[0]
    groups = max(1, -(-size // shard_bytes))
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    parts = (rows if groups == 1 else rows.filter(group == g) for g in range(groups))
    return groups, ([(r["item_id"] or "", r["text"]) for r in part.collect()] for part in parts)


def occurrences(docs: DataFrame, items: list[tuple[str, str | None]], window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, hits (numbers of hit words) and items found."""
    return _occurrences(docs, docs.sparkSession.sparkContext.broadcast(build(items, window)), "doc_id")


def _occurrences(docs: DataFrame, shared: Broadcast, key: str) -> DataFrame:
    names = [key, "n_words", "hits", "items"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streamer = Streamer(shared.value)
        for batch in batches:
            for chunk in tk.chunks(batch.column("text")):
                words, hit, found = streamer.hits(tk.lowered(chunk))
                at = np.flatnonzero(hit)
                place = np.searchsorted(at, words.first)
                numbers = at - np.repeat(words.first[:-1], np.diff(place))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(chunk.row, chunk.rows),
                        pa.array(np.diff(words.first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(numbers, pa.int64())),
                        pa.array([sorted(found.get(r, ())) for r in range(chunk.rows)], pa.list_(pa.string())),
                    ],
                    names=names,
                )

    source = docs.select(key, "text")
    schema = tk.with_fields(source.select(key), "n_words bigint, hits array<bigint>, items array<string>")
    return source.mapInArrow(stream, schema)


def _united(docs: DataFrame, groups: Iterator[list[tuple[str, str | None]]], window: int) -> tuple[DataFrame, DataFrame, str]:
    """`docs` with written row numbers; n_words, hits and items of every row over all groups, by that
    number; and its name."""
    number = f"row_{uuid.uuid4().hex}"
    docs = written(docs.withColumn(number, F.monotonically_increasing_id()), "decontamination-rows")
    whole = None
    for group in groups:
        shared = docs.sparkSession.sparkContext.broadcast(build(group, window))
        part = written(_occurrences(docs, shared, number), "decontamination-hits")
        shared.unpersist()
        whole = part if whole is None else whole.unionByName(part)
    return docs, whole.groupBy(number).agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ), number


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of `docs`."""
    number, groups = shards(items, shard_bytes)
    if number == 1:
        whole = occurrences(docs, next(groups), window)
    else:
        numbered, found, row = _united(docs.select("doc_id", "text"), groups, window)
        whole = numbered.select("doc_id", row).join(found, row)
    n_hit = F.size("hits").cast("bigint")
    return whole.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cleaned(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, most_hit: float = 0.5, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """`docs` without hit spans; texts of which more than `most_hit` of the words are hit go.

    A span reaches from its first hit word to its last one and leaves a line break. Other
    columns stay as they are. Rows without hits are not touched.
    """
    number, groups = shards(items, shard_bytes)
    if number == 1:
        return _cleaned_once(docs, next(groups), window, most_hit)
    numbered, found, row = _united(docs, groups, window)
    found = found.filter(F.size("hits") > 0).select(row, F.col("hits").alias(f"hits_{row}"))
    return _cut_out(numbered.join(found, row, "left").drop(row), docs, f"hits_{row}", most_hit)


def _cut_out(marked: DataFrame, docs: DataFrame, hits: str, most_hit: float) -> DataFrame:
    """The columns of `docs` from rows with the numbers of their hit words."""
    place = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(len(docs_columns))
            rows = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False)).tolist()
            part = batch.select(docs_columns)
            if rows:
                texts, keep = part.column(place).to_pylist(), np.ones(batch.num_rows, bool)
                for row in rows:
                    text = texts[row].encode()
                    chunk = tk.lowered(next(tk.chunks(pa.array([texts[row]], pa.string()))))
                    words = tk.find_words(chunk, tk.ALPHANUMERIC)
                    hit = np.zeros(len(words), bool)
                    hit[numbers[row].as_py()] = True
                    keep[row] = hit.mean() <= most_hit
                    texts[row] = cut(text, words.start, words.end, hit).decode()
                columns = [*part.columns]
                columns[place] = pa.array(texts, pa.string())
                part = pa.record_batch(columns, names=part.schema.names).filter(pa.array(keep))
            yield part

    docs_columns = docs.columns
    return marked.select(*docs_columns, hits).mapInArrow(clean, docs.schema)


def _cleaned_once(docs: DataFrame, items: list[tuple[str, str | None]], window: int, most_hit: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(build(items, window))
    place = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streamer = Streamer(shared.value)
        for batch in batches:
            for chunk in tk.chunks(batch.column(place)):
                words, hit, found = streamer.hits(tk.lowered(chunk))
                part = batch.slice(chunk.row, chunk.rows)
                if found:
                    texts = part.column(place).to_pylist()
                    keep = np.ones(chunk.rows, bool)
                    for row in found:
                        a, b = words.first[row], words.first[row + 1]
                        keep[row] = hit[a:b].mean() <= most_hit
                        texts[row] = cut(
                            chunk.text(row), words.start[a:b] - chunk.bounds[row], words.end[a:b] - chunk.bounds[row], hit[a:b]
                        ).decode()
                    columns = [*part.columns]
                    columns[place] = pa.array(texts, pa.string())
                    part = pa.record_batch(columns, names=batch.schema.names).filter(pa.array(keep))
                yield part

    return docs.mapInArrow(clean, docs.schema)


def cut(text: bytes, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> bytes:
    """The text with every run of hit words replaced by a line break."""
    before = np.r_[False, hit[:-1]]
    after = np.r_[hit[1:], False]
    out, at = [], 0
    for s, e in zip(start[hit & ~before].tolist(), end[hit & ~after].tolist(), strict=True):
        out += [text[at:s], b"\n"]
        at = e
    return b"".join([*out, text[at:]])


def items_digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
