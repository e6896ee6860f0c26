"""Scores of texts under an n-gram model kept in Elias-Fano tries.

Tokens are lower-cased words and one end per text. The model has three orders: single words with
add-one counts, and two- and three-word n-grams with absolute discounting, each backing off to
the order below. N-grams are kept if they occur at least LEAST times, whatever their words. What is
not kept goes to the lower order, so all probabilities of a context sum to one.

How it runs:

1. Each task turns its texts into blocks: token numbers and the distinct words of the block.
2. Distinct words are sent to buckets by hash and counted there over the whole corpus. A word that
   is frequent enough to be part of a kept n-gram gets a number of its bucket; every block gets the
   counts and numbers of its words back.
3. Distinct n-grams of each block go to the shard of their context word and are counted there. The
   shard builds its trie, maps it, and answers the n-grams that the block asked for.
4. Blocks add up the answers by text.

Only totals pass the driver; words, counts, n-grams and tries stay in their buckets and shards,
whose number follows spark.sql.shuffle.partitions.

Words are told apart by 64-bit fingerprints. Defined cases: a missing text is an empty one and
has one token, its end; without any training text, N and V are 0. Rows are scored one by one, and
rows that repeat a training document count again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.sources.shared import remember_written, shared_folder, written

from . import tokens as tk
from .elias_fano import Trie

LEAST, DISCOUNT = 2, 0.75
BLOCK_TOKENS = 2_000_000
# Compressed successors (about two bytes each) that a trie is asked for at once.
ASKED_BYTES = 200_000
# Fingerprint of the end of a text, and numbers that are no word's.
END = np.uint64(0x656E64206F662074)
NONE, RARE = (1 << 32) - 1, (1 << 32) - 2
_LOW = np.uint64(NONE)

_BLOCK = "block bigint, ids binary, sizes binary, held binary, tokens binary, words binary, counts binary, n_train bigint, n_texts int"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by decreasing frequency are small; their bytes are compressed plane by plane."""
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(raw.T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _ipc(array: pa.Array) -> bytes:
    batch = pa.record_batch([array], names=["x"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_ipc(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def blocks(docs: DataFrame, held_out: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of `docs` as blocks of tokens; ends are tokens too."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        marks, sizes, ids, held, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, size
            stream = np.concatenate(marks)
            lengths, out = np.concatenate(sizes), np.concatenate(held)
            words, back, count = np.unique(stream, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            stream = place[back]
            training = np.repeat(~out, lengths)
            counts = np.bincount(stream[training], minlength=len(words))
            row = [
                [number], [_ipc(pa.concat_arrays(ids))], [lengths.astype(np.int64).tobytes()], [out.tobytes()], [_planes(stream)],
                [words[order].tobytes()], [counts.astype(np.uint32).tobytes()], [int(training.sum())], [len(lengths)],
            ]
            number += 1
            size = 0
            for kept in (marks, sizes, ids, held):
                kept.clear()
            return pa.record_batch([pa.array(x) for x in row[:-1]] + [pa.array(row[-1], pa.int32())], names=[f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            for chunk in tk.chunks(batch.column("text")):
                words = tk.find_words(chunk, tk.NOT_SPACE)
                # an end after the last word of every row
                stream = np.insert(tk.fingerprints(chunk.data, words, lower=True), words.first[1:], END)
                part = batch.slice(chunk.row, chunk.rows)
                marks.append(stream)
                sizes.append(np.diff(words.first) + 1)
                ids.append(part.column("doc_id"))
                held.append(part.column("held").to_numpy(zero_copy_only=False))
                size += len(stream)
                if size >= block_tokens:
                    yield block()
        if size:
            yield block()

    source = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    return source.mapInArrow(cut, _BLOCK)


def _buckets(spark) -> int:
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_counts(own: DataFrame, least: float) -> DataFrame:
    """Counts and numbers of every block's words, by bucket.

    Rows: block, bucket, counts and numbers (in the order of the block's words of the bucket); and per
    bucket one row without block: known (words with a training count). Words with a training count of
    at least `least` have a number, small ones for frequent words; the others are RARE.
    """
    parts = _buckets(own.sparkSession)
    names = ["bucket", "block", "words", "counts"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "words", "counts"]).to_pylist():
                words, counts = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["counts"], np.uint32)
                bucket = (words % np.uint64(parts)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                used, at = np.unique(bucket[order], return_index=True)
                w, c = np.split(words[order], at[1:]), np.split(counts[order], at[1:])
                yield pa.record_batch(
                    [pa.array(used, pa.int32()), pa.array([row["block"]] * len(used), pa.int64()),
                     pa.array([x.tobytes() for x in w], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary())],
                    names=names,
                )

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        known, back = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(back, np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])).astype(np.int64)
        many = np.flatnonzero(total >= max(1, least))
        if len(many) * parts >= RARE:
            raise ValueError("too many words for numbers of 32 bits")
        number = np.full(len(known), RARE)
        number[many[np.argsort(-total[many], kind="stable")]] = np.arange(len(many)) * parts + rows[0]["bucket"]
        bounds = np.cumsum([len(w) for w in words])[:-1]
        replies = zip(rows, np.split(total[back], bounds), np.split(number[back], bounds), strict=True)
        out = [(r["block"], r["bucket"], _short(c), _planes(x), None) for r, c, x in replies]
        out.append((None, rows[0]["bucket"], None, None, int((total > 0).sum())))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "bucket", "counts", "numbers", "known"])

    sent = own.select("block", "words", "counts").mapInArrow(send, "bucket int, block bigint, words binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(count, "block bigint, bucket int, counts binary, numbers binary, known bigint")


def _short(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, with their width in front; compressed, as most are one."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(counts.astype(f"<u{width}").tobytes())


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


class Numbering:
    """Numbers of given words, in order of their fingerprints."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)

    def of(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        return np.where(self.words[at] == words, at, RARE) if len(self.words) else np.full(len(words), RARE)


def _replied(words: np.ndarray, parts: int, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and numbers of a block's words from the rows of the buckets."""
    count, number = np.zeros(len(words), np.int64), np.full(len(words), RARE)
    bucket = (words % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(parts + 1))
    for reply in replies:
        at = order[bounds[reply["part"]]:bounds[reply["part"] + 1]]
        count[at], number[at] = _long(reply["counts"]), _numbers(reply["numbers"])
    return count, number


def _requests(row: dict, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's tokens, their rows, the contexts and successors of its distinct n-grams, the tokens
    that have an n-gram, and its place. `number` has the numbers of the block's words.

    A context holds the word in its upper and the word before in its lower half.
    """
    stream = _numbers(row["tokens"])
    own = number[stream]
    sizes = np.frombuffer(row["sizes"], np.int64)
    # the end of the text before stands for the beginning of a text
    begin = int(number[np.frombuffer(row["words"], np.uint64) == END][0])
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    word = np.r_[begin, own[:-1]]
    word[first] = begin
    before = np.r_[NONE, word[:-1]]
    before[first] = NONE
    before[before == RARE] = NONE
    asking = np.flatnonzero(word != RARE)
    contexts, at = np.unique(word[asking].astype(np.uint64) << np.uint64(32) | before[asking].astype(np.uint64), return_inverse=True)
    distinct, back = np.unique(at.astype(np.uint64) << np.uint64(32) | own[asking].astype(np.uint64), return_inverse=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return stream, rows, contexts[distinct >> np.uint64(32)], (distinct & _LOW).astype(np.int64), asking, back


def _shard(contexts: np.ndarray, parts: int) -> np.ndarray:
    return (tk.mixed(contexts >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


_REQUEST = "shard int, block bigint, contexts binary, after binary, counts binary"


def _sent(row: dict, number: np.ndarray, parts: int) -> pa.Table:
    """The distinct n-grams of a block by shard."""
    _, rows, contexts, after, asking, back = _requests(row, number)
    training = ~np.frombuffer(row["held"], bool)[rows[asking]]
    counts = np.bincount(back[training], minlength=len(contexts)).astype(np.uint64)
    shard = _shard(contexts, parts)
    order = np.argsort(shard, kind="stable")
    used, at = np.unique(shard[order], return_index=True)
    bounds = [*at.tolist(), len(order)]
    pieces = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    return pa.table(
        [pa.array(used, pa.int32()), pa.array([row["block"]] * len(used), pa.int64()),
         pa.array([_delta(contexts[x]) for x in pieces], pa.binary()), pa.array([_planes(after[x]) for x in pieces], pa.binary()),
         pa.array([_short(counts[x]) for x in pieces], pa.binary())],
        names=["shard", "block", "contexts", "after", "counts"],
    )


def ngram_requests(own: DataFrame, numbering: Numbering) -> DataFrame:
    """shard, block, contexts, successors and training counts of the distinct n-grams of each block,
    for a given list of words."""
    parts = _buckets(own.sparkSession)
    shared = own.sparkSession.sparkContext.broadcast(numbering)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent(row, shared.value.of(np.frombuffer(row["words"], np.uint64)), parts).to_batches()

    source = own.select("block", "sizes", "held", "tokens", "words")
    return source.mapInArrow(ask, _REQUEST)


def counted_requests(own: DataFrame, replies: DataFrame) -> DataFrame:
    """As `ngram_requests`, with the numbers that the buckets gave to the words of each block."""
    parts = _buckets(own.sparkSession)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        return _sent(row, _replied(np.frombuffer(row["words"], np.uint64), parts, right.to_pylist())[1], parts)

    source = own.select("block", "sizes", "held", "tokens", "words")
    return source.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask, _REQUEST)


def _delta(keys: np.ndarray) -> bytes:
    """Increasing keys by their differences, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _split(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the word of each context."""
    return (contexts & _LOW).astype(np.int64), (contexts >> np.uint64(32)).astype(np.int64)


def _trie(rows: list[dict], least: int, discount: float) -> bytes:
    contexts, at = np.unique(np.concatenate([_keys(r["contexts"]) for r in rows]), return_inverse=True)
    after = np.concatenate([_numbers(r["after"]) for r in rows]).astype(np.uint64)
    known, back = np.unique(at.astype(np.uint64) << np.uint64(32) | after, return_inverse=True)
    del at, after
    total = np.bincount(back, np.concatenate([_long(r["counts"]) for r in rows]))
    del back
    known, total = known[total > 0], total[total > 0]
    before, word = _split(contexts[known >> np.uint64(32)])
    return Trie.build(before, word, (known & _LOW).astype(np.int64), total, NONE, RARE, least, discount).to_bytes()


def tries(requests: DataFrame, least: int = LEAST, discount: float = DISCOUNT) -> DataFrame:
    """The model itself: shard and the bytes of its trie (`Trie.mapped` opens them)."""
    def build(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.table({"shard": pa.array([rows[0]["shard"]], pa.int32()), "trie": pa.array([_trie(rows, least, discount)], pa.binary())})

    return requests.groupBy("shard").applyInArrow(build, "shard int, trie binary")


def answers(requests: DataFrame, least: int = LEAST, discount: float = DISCOUNT) -> DataFrame:
    """block, shard, a, b: for every requested n-gram the share a of its probability that is
    its own, and the weight b of the successor's probability alone."""
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        trie = Trie.mapped(_trie(rows, least, discount))
        out = []
        for asked in _together(rows):
            keys, after = [_keys(r["contexts"]) for r in asked], [_numbers(r["after"]) for r in asked]
            a, b = trie.query(*_split(np.concatenate(keys)), np.concatenate(after))
            bounds = np.cumsum([len(k) for k in keys])[:-1]
            answered = zip(asked, np.split(a, bounds), np.split(b, bounds), strict=True)
            out += [(r["block"], r["shard"], _floats(x), _floats(y)) for r, x, y in answered]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "shard", "a", "b"])

    return requests.groupBy("shard").applyInArrow(answer, "block bigint, shard int, a binary, b binary")


def _together(rows: list[dict]) -> Iterator[list[dict]]:
    """Requests of many blocks that are answered at once: small ones together, a large one alone."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row["after"])
        if size >= ASKED_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _floats(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(values.astype(np.float32).tobytes())


def _from_floats(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.float32).astype(np.float64)


def scores(
    docs: DataFrame, held_out: Column, frequent: float = 0.0, least: int = LEAST, discount: float = DISCOUNT,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of `docs`.

    Rows for which `held_out` holds teach nothing. With `frequent`, words that hold a smaller share of
    all training tokens are in no n-gram.
    """
    own = _stored(blocks(docs, held_out, block_tokens), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_train = own.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    counted = written(word_counts(own, max(least, frequent * n_train)), "ngram-words")
    v_train = counted.filter("block IS NULL").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    replies = counted.filter("block IS NOT NULL").select("block", F.col("bucket").alias("part"), "counts", "numbers")
    told = answers(counted_requests(own, replies), least, discount)
    parts = _buckets(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        row = left.to_pylist()[0]
        answered = right.to_pylist()
        count, number = _replied(np.frombuffer(row["words"], np.uint64), parts, [r for r in answered if r["counts"] is not None])
        stream, rows, contexts, _, asking, back = _requests(row, number)
        shard = _shard(contexts, parts)
        a, b = np.zeros(len(contexts)), np.ones(len(contexts))
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(parts + 1))
        for reply in answered:
            if reply["counts"] is None:
                at = order[bounds[reply["part"]]:bounds[reply["part"] + 1]]
                a[at], b[at] = _from_floats(reply["a"]), _from_floats(reply["b"])
        alone = np.log10((count + 1.0) / (n_train + v_train + 1.0))[stream]
        best = alone.copy()
        best[asking] = np.log10(a[back] + b[back] * 10.0 ** alone[asking])
        n = row["n_texts"]
        return pa.table(
            {
                "doc_id": _from_ipc(row["ids"]), "held_out": pa.array(np.frombuffer(row["held"], bool)),
                "n_tokens": pa.array(np.bincount(rows, minlength=n), pa.int64()),
                "n_known": pa.array(np.bincount(rows, (count > 0)[stream], n).astype(np.int64)),
                "base_score": pa.array(np.bincount(rows, alone, n)), "score": pa.array(np.bincount(rows, best, n)),
            }
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    empty = pa.table({
        "doc_id": pa.array([], _arrow_kind(docs)), "held_out": pa.array([], pa.bool_()),
        "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()),
        "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()),
    })
    nothing = F.lit(None).cast("binary")
    replies = replies.select("block", "part", "counts", "numbers", nothing.alias("a"), nothing.alias("b"))
    replies = replies.union(told.select("block", F.col("shard").alias("part"), nothing.alias("counts"), nothing.alias("numbers"), "a", "b"))
    left = own.select("block", "ids", "sizes", "held", "tokens", "words", "n_texts")
    found = left.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")


def _stored(own: DataFrame, buckets: int) -> DataFrame:
    """The blocks as a table in buckets, so that replies are sent to where blocks lie and blocks are never shuffled."""
    spark = own.sparkSession
    table = f"ngram_blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    own.write.bucketBy(buckets, "block").option("path", path).saveAsTable(table)
    remember_written(spark, path)
    return spark.table(table)


def _arrow_kind(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
