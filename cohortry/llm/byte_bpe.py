"""Byte-level BPE as a monoid: encode halves, join neighbours, concatenate to decode.

A piece of text (one match of the splitting pattern) is encoded by encoding its two halves and
joining the results. Joining re-encodes a window around the seam, which grows until the tokens
left and right of it provably stay: a sequence of tokens is the encoding of its bytes exactly if
every two neighbours are the encoding of their joint bytes, so it is enough that the window's
outer tokens stand this test with the tokens outside it. Decoding maps tokens to bytes and
concatenates, in any grouping.

Defined cases: a missing text is encoded like an empty one, to no tokens. Rows are encoded one
by one, so repeated rows give repeated results. Special tokens do not exist: their spelling is
ordinary text. Texts may have any length; a piece costs its length times the depth of the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .tokens import with_fields

# A part of up to LEAF bytes is merged directly. Seams, short parts and whole pieces of up to
# REMEMBERED bytes are remembered; a memory is emptied when it reaches MEMORY entries (LARGE_MEMORY where a
# Python worker has nothing else to hold).
LEAF, REMEMBERED, MEMORY, LARGE_MEMORY = 4, 48, 100_000, 250_000
NONE = 1 << 62  # the rank of what cannot be merged
# Rows that are turned into Python strings at a time.
ROWS = 128

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """The merge ranks of a vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes texts by the ranks of a vocabulary and its splitting pattern."""

    def __init__(self, ranks: Ranks, pattern: str, memory: int | None = None):
        self.ranks = ranks
        self.memory = MEMORY if memory is None else memory
        self.token = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self._parts: dict[bytes, tuple[int, ...]] = {}
        self._seams: dict[int, tuple[int, ...]] = {}
        self._pieces: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def forget(self) -> None:
        """Empty all memories; a Python worker outlives its task."""
        for memory in (self._parts, self._seams, self._pieces):
            memory.clear()

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merge neighbours of lowest rank, leftmost first, until none can be merged."""
        if len(data) > 48:
            return self._merged_by_heap(data)
        rank = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = [rank(data[i:i + 2], NONE) for i in range(len(data) - 1)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NONE)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NONE)
        return tuple([self.ranks[p] for p in parts])

    def _merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        n, rank = len(data), self.ranks.get
        end = list(range(1, n + 1))  # of the part that begins here; 0 if none does
        previous = list(range(-1, n - 1))
        todo = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n:
                stop = end[end[i]]
                r = rank(data[i:stop])
                if r is not None:
                    heapq.heappush(todo, (r, i, stop))

        for i in range(n - 1):
            offer(i)
        while todo:
            _, i, stop = heapq.heappop(todo)
            middle = end[i]
            if not middle or middle >= n or not end[middle] or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                previous[stop] = i
            offer(previous[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i:end[i]]])
            i = end[i]
        return tuple(out)

    def seam(self, left: int, right: int) -> tuple[int, ...]:
        """The encoding of two tokens' joint bytes, or nothing if it is these two tokens."""
        key = left << 32 | right
        found = self._seams.get(key)
        if found is None:
            if len(self._seams) >= self.memory:
                self._seams.clear()
            found = self.merged(self.token[left] + self.token[right])
            if found == (left, right):
                found = ()
            self._seams[key] = found
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joint bytes of two encodings."""
        if not left or not right:
            return left + right
        window = self.seam(left[-1], right[0])
        if not window:
            return left + right
        i = j = 1
        while True:
            wider_left = i < len(left) and self.seam(left[-i - 1], window[0])
            wider_right = j < len(right) and self.seam(window[-1], right[j])
            if not (wider_left or wider_right):
                return left[:len(left) - i] + window + right[j:]
            if wider_left:
                i = min(len(left), 2 * i)
            if wider_right:
                j = min(len(right), 2 * j)
            window = self.remembered(b"".join([self.token[t] for t in left[len(left) - i:] + right[:j]]))

    def remembered(self, data: bytes) -> tuple[int, ...]:
        """Merge directly, once for each short string."""
        found = self._parts.get(data)
        if found is None:
            found = self.merged(data)
            if len(data) <= REMEMBERED:
                if len(self._parts) >= self.memory:
                    self._parts.clear()
                self._parts[data] = found
        return found

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Encode a part of a piece by its halves."""
        if len(data) <= LEAF:
            return self.remembered(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def piece(self, text: str) -> tuple[int, ...]:
        """Encode one match of the splitting pattern; a token of the vocabulary is itself."""
        data = text.encode()
        rank = self.ranks.get(data)
        return (rank,) if rank is not None else self.tree(data)

    def encoded(self, text: str | None) -> list[tuple[tuple[int, ...], str, bytes]]:
        """The pieces of a text: tokens, tokens as decimal text, and what they decode to."""
        pieces, out = self._pieces, []
        for piece in self.split(text or ""):
            found = pieces.get(piece)
            if found is None:
                ids = self.piece(piece)
                found = ids, " ".join(map(str, ids)), self.decode(ids)
                if len(piece) <= REMEMBERED:
                    if len(pieces) >= self.memory:
                        pieces.clear()
                    pieces[piece] = found
            out.append(found)
        return out

    def encode(self, text: str | None) -> list[int]:
        """All tokens of a text."""
        return [i for ids, _, _ in self.encoded(text) for i in ids]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of tokens."""
        return b"".join([self.token[i] for i in ids])


_codecs: dict[int, Codec] = {}


def codec_of(shared: Broadcast, pattern: str, memory: int | None = None) -> Codec:
    """The codec of a broadcast vocabulary; a Python worker keeps the last one."""
    key = hash((len(shared.value), pattern, memory, *sorted(shared.value.items())[::997]))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern, memory)
    return _codecs[key]


def with_tokens(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", tokens: str = "token_ids") -> DataFrame:
    """`docs` with the tokens of their texts in an array column (replaced if it exists).

    The vocabulary is read on the driver and broadcast; it is a fixed file of a few MB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rest = [c for c in docs.columns if c != tokens]
    schema = with_fields(docs.select(*[f"`{c}`" for c in rest]), f"`{tokens}` array<int>")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            for part in _parts(batch):
                ids = pa.array([codec.encode(t) for t in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.record_batch([*part.columns, ids], names=[*rest, tokens])
        codec.forget()

    return docs.select(*[f"`{c}`" for c in rest]).mapInArrow(encode, schema)


def with_restored(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with token_ids, n_tokens and restored: whether the tokens decode to the text again.

    One pass; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    added = ["token_ids", "n_tokens", "restored"]
    rest = [c for c in docs.columns if c not in added]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(text).to_pylist()
                ids = [codec.encode(t) for t in texts]
                same = [codec.decode(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
                yield pa.record_batch(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int32()), pa.array(same)],
                    names=[*rest, *added],
                )
        codec.forget()

    source = docs.select(*[f"`{c}`" for c in rest])
    return source.mapInArrow(encode, with_fields(source, "token_ids array<int>, n_tokens int, restored boolean"))


def with_decoded(frame: DataFrame, ranks_path: str, pattern: str, tokens: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """`frame` with the bytes of its tokens in a binary column (replaced if it exists)."""
    shared = frame.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rest = [c for c in frame.columns if c != decoded]
    schema = with_fields(frame.select(*[f"`{c}`" for c in rest]), f"`{decoded}` binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            for part in _parts(batch):
                data = pa.array([codec.decode(ids or []) for ids in part.column(tokens).to_pylist()], pa.binary())
                yield pa.record_batch([*part.columns, data], names=[*rest, decoded])

    return frame.select(*[f"`{c}`" for c in rest]).mapInArrow(decode, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode every text, decode the tokens, and keep only their digests.

    Columns: doc_id, n_tokens, ids_sha256 (decimal tokens joined by a blank) and decoded_sha256.
    One pass, so that neither tokens nor bytes leave the task. Memories outlive a task: its pieces recur in the next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern, LARGE_MEMORY)
        for batch in batches:
            for part in _parts(batch):
                found = []
                for value in part.column(text).to_pylist():
                    pieces = codec.encoded(value)
                    found.append((
                        sum([len(ids) for ids, _, _ in pieces]),
                        hashlib.sha256(" ".join([shown for _, shown, _ in pieces]).encode()).hexdigest(),
                        hashlib.sha256(b"".join([data for _, _, data in pieces])).hexdigest(),
                    ))
                count, ids_hash, text_hash = zip(*found, strict=True)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=names
                )

    source = docs.select("doc_id", f"`{text}`")
    schema = with_fields(source.select("doc_id"), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return source.mapInArrow(digest, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)
