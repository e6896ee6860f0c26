"""Removal of passages that repeat anywhere in a corpus, found by an FM-index per shard.

A window of WIDTH words is repeated if its word sequence also starts somewhere else, in the same
text or another one. Every word of a repeated window goes.

Windows meet by content. The anchor of a window is the sequence of ANCHOR words in it with the
smallest fingerprint, the first one at ties, so equal windows have equal anchors. Neighbouring
windows share their anchor, and a text has one passage per anchor: the words of these windows.

1. Anchors are counted (pre-aggregated) and only passages whose anchor occurs again go on.
2. Passages are sent to shards by anchor. A task drops passages it has sent before, so many
   copies arrive as one row per task. Anchors with more than DENSE occurrences are sent window by
   window, keyed by the whole window, so that a crowded anchor spreads over shards and again
   collapses.
3. Each shard is indexed, and its passages are streamed through the index by backward search.
   Since equal windows are in one shard, a count of two or more means repeated.
4. Results are joined to the places of the passages and applied to the texts.

Fingerprints only route; in a shard words are compared by their bytes. Texts are shuffled once,
results go by document.

Defined cases: words are separated by ASCII blanks; a missing text has none. Texts of fewer
words than a window stay. Rows that repeat a document are occurrences of their own, so both lose
their windows; rows with one doc_id and different texts are different documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.shared import written

from . import tokens as tk
from .fm_index import FMIndex

WIDTH, ANCHOR = 35, 8
# Occurrences beyond which an anchor's windows travel one by one. Rows do not depend on it.
DENSE = 400
# Words of a shard; groups of one anchor are not cut.
SHARD_WORDS = 300_000
# Distinct passages that a task remembers before it sends them.
REMEMBERED = 20_000
ROWS = 256

_NO_ID = -(1 << 63)


def _identified(docs: DataFrame) -> DataFrame:
    """The texts with an identity that tells documents apart: doc, mark."""
    kind = docs.schema["doc_id"].dataType
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID).cast(kind)).alias("doc"), F.xxhash64("text").alias("mark"), "text")


def anchors(texts: DataFrame, width: int, anchor: int) -> DataFrame:
    """anchor, doc, mark, place for every passage; place is first window * 256 + windows after it."""
    names = ["anchor", "doc", "mark", "place"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tk.chunks(batch.column("text")):
                row, number, first, last = passages_of(chunk, width, anchor)
                part = batch.slice(chunk.row, chunk.rows)
                at = pa.array(row)
                yield pa.record_batch(
                    [
                        pa.array(number.view(np.int64)), part.column("doc").take(at), part.column("mark").take(at),
                        pa.array(first << 8 | (last - first)),
                    ],
                    names=names,
                )

    source = texts.select("doc", "mark", "text")
    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInArrow(find, f"anchor bigint, doc {kind}, mark bigint, place bigint")


def passages_of(chunk: tk.Chunk, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor, and first and last window (word numbers in the row) of every passage."""
    words = tk.find_words(chunk, tk.NOT_SPACE)
    marks = tk.sequence_fingerprints(tk.fingerprints(chunk.data, words), anchor)
    span = width - anchor + 1
    if len(marks) < span:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none
    least = np.lib.stride_tricks.sliding_window_view(marks, span).argmin(axis=1)
    start = np.arange(len(least))
    rows = tk.row_of_words(words)[:len(least)]
    inside = start + width <= words.first[rows + 1]
    start, rows = start[inside], rows[inside]
    at = start + least[inside]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(at)][:len(heads)] - 1
    base = words.first[rows[heads]]
    return rows[heads], marks[at[heads]], start[heads] - base, start[tails] - base


def _key(group: int, passage: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(passage, digest_size=16, salt=group.to_bytes(8, "little", signed=True)).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _slices(words: list[bytes], found: list[dict], width: int, dense: int) -> Iterator[tuple[int, int, bytes]]:
    """(group, first window, words) of a text's passages, or of its windows at crowded anchors."""
    for one in found:
        first, more = one["place"] >> 8, one["place"] & 255
        if one["n"] <= dense:
            yield one["anchor"], first, b" ".join(words[first:first + more + width])
        else:
            for start in range(first, first + more + 1):
                window = b" ".join(words[start:start + width])
                yield int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), start, window


def _travelling(matched: DataFrame, width: int, dense: int, what: str) -> DataFrame:
    """The passages themselves, each once per task (grp, k1, k2, passage, n), or their places
    (k1, k2, doc, mark, first)."""
    def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[dict]]]:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for i, (text, found) in enumerate(zip(part.column("text"), part.column("found").to_pylist(), strict=True)):
                yield at + i, text.as_buffer().to_pybytes().split(), found

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}

        def flush() -> pa.RecordBatch:
            columns = list(zip(*seen.values(), strict=True)) or [()] * 3
            keys = list(zip(*seen, strict=True)) or [()] * 2
            out = pa.record_batch(
                [
                    pa.array(columns[0], pa.int64()), pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()),
                    pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32()),
                ],
                names=["grp", "k1", "k2", "passage", "n"],
            )
            seen.clear()
            return out

        for batch in batches:
            for _, words, found in texts(batch):
                for group, _, passage in _slices(words, found, width, dense):
                    known = seen.setdefault(_key(group, passage), [group, passage, 0])
                    known[2] = min(2, known[2] + 1)
                if len(seen) > REMEMBERED:
                    yield flush()
        yield flush()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, firsts = [], [], []
            for row, words, found in texts(batch):
                for group, first, passage in _slices(words, found, width, dense):
                    rows.append(row)
                    keys.append(_key(group, passage))
                    firsts.append(first)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    batch.column("doc").take(at), batch.column("mark").take(at), pa.array(firsts, pa.int64()),
                ],
                names=["k1", "k2", "doc", "mark", "first"],
            )

    if what == "passages":
        return matched.mapInArrow(passages, "grp bigint, k1 bigint, k2 bigint, passage binary, n int")
    kind = matched.schema["doc"].dataType.simpleString()
    return matched.mapInArrow(places, f"k1 bigint, k2 bigint, doc {kind}, mark bigint, first bigint")


def word_numbers(data: np.ndarray, words: tk.Words) -> np.ndarray:
    """Numbers from 1 on, equal exactly for words of equal bytes."""
    _, head, number = np.unique(tk.fingerprints(data, words), return_index=True, return_inverse=True)
    # every word is compared with the first one of its number, all bytes at once
    length = words.end - words.start
    shift = words.start[head][number] - words.start
    at = np.flatnonzero(tk.NOT_SPACE[data])
    same = (length == length[head][number]).all() and (data[at] == data[at + np.repeat(shift, length)]).all()
    if not same:
        spelled: dict[bytes, int] = {}
        pairs = zip(words.start.tolist(), words.end.tolist(), strict=True)
        number = np.array([spelled.setdefault(data[s:e].tobytes(), len(spelled)) for s, e in pairs])
    return number + 1


def repeated_windows(passages: list[bytes], copies: list[int], width: int) -> list[int]:
    """For each passage of a shard, a number whose bit t says that its window t is repeated."""
    data = np.frombuffer(b"".join(passages), np.uint8)
    words = tk.find_words(tk.Chunk(0, data, np.r_[0, np.cumsum([len(p) for p in passages])]), tk.NOT_SPACE)
    number = word_numbers(data, words)
    index = FMIndex(np.insert(number, words.first[1:], 0), int(number.max()) + 1, width)
    counts, places = index.matching_counts(number, words.first)
    hit = (counts >= 2) | np.repeat(np.array(copies) >= 2, np.diff(places))
    bits = hit.astype(np.int64) << (np.arange(len(hit)) - np.repeat(places[:-1], np.diff(places)))
    return np.add.reduceat(bits, places[:-1]).tolist()


def _decided(passages: DataFrame, width: int, shard_words: int) -> DataFrame:
    """k1, k2, windows for every passage with a repeated window."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[tuple[int, int], list] = {}
        size, last = 0, None

        def result() -> pa.RecordBatch:
            masks = repeated_windows([p for p, _ in shard.values()], [n for _, n in shard.values()], width) if shard else []
            found = [(k, m) for k, m in zip(shard, masks, strict=True) if m]
            shard.clear()
            return pa.record_batch(
                [pa.array([f(x) for x in found], pa.int64()) for f in (lambda x: x[0][0], lambda x: x[0][1], lambda x: x[1])],
                names=["k1", "k2", "windows"],
            )

        for batch in batches:
            columns = (batch.column(c) for c in ("grp", "k1", "k2", "passage", "n"))
            for group, k1, k2, passage, n in zip(*(c.to_pylist() for c in columns), strict=True):
                if size >= shard_words and group != last:
                    yield result()
                    size = 0
                last = group
                if (k1, k2) in shard:
                    shard[k1, k2][1] = 2
                else:
                    shard[k1, k2] = [passage, n]
                    size += passage.count(b" ") + 2
        yield result()

    shards = passages.repartition("grp").sortWithinPartitions("grp")
    return shards.mapInArrow(search, "k1 bigint, k2 bigint, windows bigint")


def without_repeats(
    docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, dense: int = DENSE, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by a blank), one row per row of `docs`."""
    if not 0 < anchor <= width <= anchor + 60:
        raise ValueError("a window must hold its anchor and at most 60 windows may share one")
    texts = _identified(docs)
    found = anchors(texts, width, anchor)
    # rows that repeat a document would each add the same passages again, so these are made distinct where they are gathered.
    # a written table as the other side of the join lets adaptive execution split a crowded anchor
    again = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-anchors")
    here = found.join(again.hint("shuffle_hash"), "anchor").repartition("doc", "mark").distinct().groupBy("doc", "mark").agg(
        F.collect_list(F.struct("anchor", "place", "n")).alias("found")
    )
    # the side of the texts is streamed, not sorted, and shuffled once for both joins
    matched = texts.join(here.hint("shuffle_hash"), ["doc", "mark"]).select("doc", "mark", "text", "found")
    decided = _decided(_travelling(matched, width, dense, "passages"), width, shard_words)
    places = _travelling(matched, width, dense, "places").join(decided.hint("shuffle_hash"), ["k1", "k2"])
    removed = places.select("doc", "mark", "first", "windows").repartition("doc", "mark").distinct().groupBy("doc", "mark").agg(
        F.collect_list(F.struct("first", "windows")).alias("windows")
    )
    whole = texts.join(removed.hint("shuffle_hash"), ["doc", "mark"], "left").select(
        F.when(F.col("doc") != F.lit(_NO_ID).cast(docs.schema["doc_id"].dataType), F.col("doc")).alias("doc_id"), "text", "windows"
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n_words, n_removed, kept = [], [], []
                for text, windows in zip(part.column("text"), part.column("windows").to_pylist(), strict=True):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    n_words.append(len(words))
                    if windows:
                        gone = covered(len(words), windows, width)
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return whole.mapInArrow(apply, tk.with_fields(docs.select("doc_id"), "n_words bigint, n_removed bigint, kept string"))


def covered(n: int, windows: list[dict], width: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for one in windows:
        mask, start = one["windows"], one["first"]
        while mask:
            if mask & 1:
                edge[start] += 1
                edge[start + width] -= 1
            mask >>= 1
            start += 1
    return np.cumsum(edge[:n]) > 0
