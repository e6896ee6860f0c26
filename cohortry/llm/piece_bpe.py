"""SentencePiece encoding and decoding by rounds of merges over flat arrays of symbols.

A text, its blanks written as U+2581 and one put in front, is cut into words where no piece of the
model can span, so words are encoded on their own. The distinct words of a chunk of texts form one
flat array of symbols with a segment number each. In a round every segment takes its best pair (the
highest score) and merges all of its occurrences at once, leftmost first where they overlap; the array
is compacted, only pairs beside a merged symbol are looked up again, and segments without a pair leave.

Merging one by one could differ from a round in one case: a new pair beside a merged symbol, with the next occurrence
merged or not yet, is as good as the pair of the round or better, and would have come first. A segment in which
that happens after several merges goes back and is merged one by one, in order, with a heap; so does one that
is not finished after ROUNDS rounds. Results equal those of the sentencepiece library.

What no piece contains is written as the byte pieces of its UTF-8 form. Decoding joins the bytes of pieces; the blank put in front is taken off.

Defined cases: a missing text is encoded like an empty one, to no pieces. Rows are encoded one by one,
so repeated rows give repeated results. Control pieces do not exist in texts: their spelling is ordinary text.
Texts and words may have any length. Columns of an added name are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from .tokens import with_fields

BLANK = "▁"
# Rounds after which a segment is merged one by one: only very long words need so many.
ROUNDS = 256
# Words remembered by a worker before only those of the last chunk stay, and characters of a word that is.
MEMORY, REMEMBERED = 150_000, 64
# Texts encoded together, by rows and by characters (a longer text is a chunk of its own).
ROWS, CHARS = 1024, 1 << 21
NONE = np.iinfo(np.int32).max  # the rank of a pair that is no piece
UNKNOWN = 1 << 24  # symbols from here on are characters that no piece contains


# A word's number of pieces, the pieces as decimal text, and what they decode to: no lists, as many are remembered.
Word = tuple[int, str, bytes]


def ids_of(words: Sequence[Word]) -> list[int]:
    """The pieces of some words."""
    return [int(i) for _, shown, _ in words for i in shown.split(",")]


@dataclass(frozen=True)
class Model:
    """Pieces, merge ranks and settings of a sentencepiece model file."""

    pieces: tuple[str, ...]
    ranks: dict[str, int]
    bytes_: dict[int, int]
    silent: frozenset[int]
    unknown: int
    unknown_text: str
    prefix: bool


def read_model(path: str) -> Model:
    """Read a BPE model file; only models with byte pieces that take texts unchanged (identity normalisation) are accepted."""
    with open(path, "rb") as data:
        proto = ModelProto.FromString(data.read())
    kind = ModelProto.SentencePiece.Type
    rules, training = proto.normalizer_spec, proto.trainer_spec
    plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    known = {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE}
    if training.model_type != training.BPE or not plain or training.treat_whitespace_as_suffix or any(
        p.type not in known for p in proto.pieces
    ) or sum(p.type == kind.BYTE for p in proto.pieces) != 256:
        raise ValueError("the model must be BPE with byte pieces, unchanged texts and ordinary pieces")
    normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL]
    place = {s: r for r, s in enumerate(sorted({p.score for _, p in normal}, reverse=True))}
    return Model(
        tuple(p.piece for p in proto.pieces),
        {p.piece: place[p.score] for _, p in normal},
        {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE},
        frozenset(i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL),
        next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN),
        training.unk_surface, rules.add_dummy_prefix,
    )


class PieceCodec:
    """Encodes and decodes texts by a model."""

    def __init__(self, model: Model):
        self.model = model
        number = {p: i for i, p in enumerate(model.pieces) if p in model.ranks}
        inside = sorted({c for p in number for c in p if c not in number})
        # characters that occur in pieces but are none get numbers beyond the pieces
        self._symbol = number | {c: len(model.pieces) + k for k, c in enumerate(inside)}
        self._text = {s: p for p, s in self._symbol.items()}
        pairs = {}
        for piece, piece_id in number.items():
            for i in range(1, len(piece)):
                left, right = self._symbol.get(piece[:i]), self._symbol.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = model.ranks[piece], piece_id
        self._pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self._key = np.append(keys, -1)
        self._rank = np.array([*(pairs[k][0] for k in keys.tolist()), NONE], np.int32)
        self._merged = np.array([*(pairs[k][1] for k in keys.tolist()), 0], np.int32)
        chars = [c for c in self._symbol if len(c) == 1]
        self._of_char = np.arange(UNKNOWN, UNKNOWN + 0x110000, dtype=np.int32)
        self._of_char[[ord(c) for c in chars]] = [self._symbol[c] for c in chars]
        beside = {(a, b) for p in number for a, b in zip(p, p[1:], strict=False)}
        self._words = re.compile(self._word_pattern(beside), re.DOTALL).findall
        # pairs of characters in square tables; characters that stand alone are number 0
        social = sorted({c for pair in beside for c in pair})
        place = {c: i for i, c in enumerate(social, 1)}
        self._class = np.zeros(0x110000, np.int32)
        self._class[[ord(c) for c in social]] = range(1, len(social) + 1)
        self._width = len(social) + 1
        self._together = np.zeros(self._width**2, bool)
        self._first_rank = np.full(self._width**2, NONE, np.int32)
        self._first_merged = np.zeros(self._width**2, np.int32)
        for a, b in beside:
            at = place[a] * self._width + place[b]
            self._together[at] = True
            found = pairs.get(self._symbol[a] << 32 | self._symbol[b])
            if found:
                self._first_rank[at], self._first_merged[at] = found

        spoken = {i: p.replace(BLANK, " ").encode() for i, p in enumerate(model.pieces)}
        spoken |= {i: b"" for i in model.silent} | {model.unknown: model.unknown_text.encode()}
        self._is_byte = {i: bytes([b]) for b, i in model.bytes_.items()}
        spoken |= self._is_byte
        self._bytes = [spoken[i] for i in range(len(model.pieces))]
        self._decimal = [str(i) for i in range(len(model.pieces))]
        self._memory: dict[str, Word] = {}

    @staticmethod
    def _word_pattern(beside: set[tuple[str, str]]) -> str:
        """Words end where no piece goes on: before a blank after anything else, and at ASCII characters that are
        always pieces of their own."""
        if any(b == BLANK and a != BLANK for a, b in beside):
            return ".+"
        social = {c for pair in beside for c in pair}
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in social)
        return f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else "")

    def words(self, text: str | None) -> list[str]:
        """The words of a text, in order; joined they are the text as the model reads it."""
        if not text:
            return []
        return self._words((BLANK if self.model.prefix else "") + text.replace(" ", BLANK))

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of pairs."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self._key[:-1], key)
        at[self._key[at] != key] = len(self._key) - 1
        return self._rank[at], self._merged[at]

    def _rounds(
        self, symbol: np.ndarray, segment: np.ndarray, rank: np.ndarray, merged: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Merge all segments; the remaining symbols in order, and their segments.

        `rank` and `merged` belong to the pairs that begin at each symbol.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for turn in range(ROUNDS + 1):
            if not len(symbol):
                break
            head = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            size = np.diff(np.append(head, len(symbol)))
            best = np.minimum.reduceat(rank, head)
            goes_on = np.repeat(best < NONE, size)
            if not goes_on.all():
                done.append((symbol[~goes_on], segment[~goes_on]))
                symbol, segment, rank, merged = (x[goes_on] for x in (symbol, segment, rank, merged))
                size, best = size[best < NONE], best[best < NONE]
                if not len(symbol):
                    break
            if turn == ROUNDS:
                done.append(self._one_by_one(symbol, segment))
                break
            own_best = np.repeat(best, size)
            # of neighbouring occurrences every second one, from the left
            found = rank == own_best
            at = np.arange(len(symbol))
            first = found & ~np.append(False, found[:-1] & (segment[1:] == segment[:-1]))
            chosen = found & ((at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0)
            gone = np.append(False, chosen[:-1])
            stays = ~gone
            new_symbol = np.where(chosen, merged, symbol)[stays]
            new_segment, new_best = segment[stays], own_best[stays]
            new_rank, new_merged = rank[stays], merged[stays]
            # pairs that begin with a merged symbol or end with one
            met = chosen[stays]
            met[:-1] |= met[1:].copy()
            look = np.flatnonzero(met)
            inner = look[look + 1 < len(new_symbol)]
            inner = inner[new_segment[inner] == new_segment[inner + 1]]
            new_rank[look] = NONE
            new_rank[inner], new_merged[inner] = self._looked_up(new_symbol[inner], new_symbol[inner + 1])
            # as good as the round's pair or better: only the leftmost merge is certain
            early = np.zeros(len(best), bool)
            number = np.repeat(np.arange(len(best)), size)
            early[number[stays][inner[new_rank[inner] <= new_best[inner]]]] = True
            # a merged symbol meets the next occurrence while that is still apart
            next_too = np.flatnonzero(chosen[:-2] & chosen[2:] & (segment[:-2] == segment[2:]))
            meets, _ = self._looked_up(merged[next_too], symbol[next_too + 2])
            early[number[next_too[meets <= own_best[next_too]]]] = True
            early &= np.bincount(number[chosen], minlength=len(best)) > 1
            if early.any():
                back = early[number]
                done.append(self._one_by_one(symbol[back], segment[back]))
                keep = ~early[number[stays]]
                new_symbol, new_segment, new_rank, new_merged = (x[keep] for x in (new_symbol, new_segment, new_rank, new_merged))
            symbol, segment, rank, merged = new_symbol, new_segment, new_rank, new_merged
        if not done:
            return symbol, segment
        symbol, segment = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(segment, kind="stable")
        return symbol[order], segment[order]

    def _one_by_one(self, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for segments whose merges have to come in order."""
        part, n = symbol.tolist(), len(symbol)
        own = segment.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        todo: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and own[i] == own[j]:
                found = self._pairs.get(part[i] << 32 | part[j])
                if found:
                    heapq.heappush(todo, (found[0], i, part[i], part[j]))

        for i in range(n):
            offer(i)
        while todo:
            _, i, left, right = heapq.heappop(todo)
            j = after[i]
            if not alive[i] or part[i] != left or j >= n or part[j] != right or own[i] != own[j]:
                continue
            part[i] = self._pairs[left << 32 | right][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        keep = np.array(alive, bool)
        return np.array(part, np.int32)[keep], segment[keep]

    def _ids(self, symbol: int) -> list[int]:
        """The pieces of a symbol: itself, or the bytes of what is no piece."""
        if symbol < len(self.model.pieces):
            return [symbol]
        text = chr(symbol - UNKNOWN) if symbol >= UNKNOWN else self._text[symbol]
        return [self.model.bytes_[b] for b in text.encode()]

    def encoded_words(self, words: Sequence[str]) -> Iterator[list[int]]:
        """The pieces of every word; all words are merged together."""
        if not words:
            return
        length = np.fromiter(map(len, words), np.int64, len(words))
        char = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        kind = self._class[char]
        pair = kind[:-1] * self._width + kind[1:]
        # a word is cut again between characters that no piece has beside each other
        cut = ~self._together[pair] | (word[1:] != word[:-1])
        segment = np.append(np.int32(0), np.cumsum(cut, dtype=np.int32))
        of_segment = word[np.append(0, np.flatnonzero(cut) + 1)]
        rank = np.append(np.where(cut, np.int32(NONE), self._first_rank[pair]), np.int32(NONE))
        merged = np.append(self._first_merged[pair], np.int32(0))
        symbol, segment = self._rounds(self._of_char[char], segment, rank, merged)
        owner = of_segment[segment]
        bound = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        strange = set(np.unique(owner[symbol >= len(self.model.pieces)]).tolist())
        flat = symbol.tolist()
        for w, (a, b) in enumerate(zip(bound, bound[1:], strict=False)):
            ids = flat[a:b]
            if w in strange:
                ids = [i for s in ids for i in self._ids(s)]
            yield ids

    def encoded(self, texts: Sequence[str | None]) -> Iterator[list[Word]]:
        """The words of every text."""
        cut = [self.words(t) for t in texts]
        memory, decimal, spoken = self._memory, self._decimal, self._bytes
        seen = set().union(*cut)
        new = list(seen.difference(memory))
        for word, ids in zip(new, self.encoded_words(new), strict=True):
            memory[word] = len(ids), ",".join([decimal[i] for i in ids]), b"".join([spoken[i] for i in ids])
        for words in cut:
            yield [memory[w] for w in words]
        for word in [w for w in new if len(w) > REMEMBERED]:
            del memory[word]
        if len(memory) > MEMORY:
            self._memory = {w: memory[w] for w in seen if w in memory}

    def encode(self, text: str | None) -> list[int]:
        """All pieces of a text."""
        return [i for words in self.encoded([text]) for i in ids_of(words)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of pieces; bytes that are no UTF-8 become U+FFFD."""
        try:
            text = b"".join([self._bytes[i] for i in ids]).decode()
        except UnicodeDecodeError:
            text = self._decoded_runs(ids)
        # the blank in front belongs to the first piece that is not silent
        lead = next((i for i in ids if i not in self.model.silent), None)
        begins = lead is not None and lead not in self._is_byte and self._bytes[lead].startswith(b" ") and lead != self.model.unknown
        return text[1:] if self.model.prefix and begins else text

    def _decoded_runs(self, ids: Sequence[int]) -> str:
        """Runs of byte pieces are decoded on their own, every byte that fits nowhere alone."""
        out, run = [], []

        def flush() -> None:
            data = b"".join(run)
            run.clear()
            at = 0
            while at < len(data):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(data[at:at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size

        for i in ids:
            if i in self._is_byte:
                run.append(self._is_byte[i])
            else:
                flush()
                out.append(self._bytes[i].decode())
        flush()
        return "".join(out)

    def decoded(self, words: Sequence[Word]) -> bytes:
        """The decoded text of the words that `encoded` gave for one text, in UTF-8."""
        data = b"".join([w[2] for w in words])
        return data[1:] if self.model.prefix and data.startswith(b" ") else data


_codecs: dict[int, PieceCodec] = {}


def codec_of(shared: Broadcast) -> PieceCodec:
    """The codec of a broadcast model; a Python worker keeps the last one."""
    key = hash(shared.value.pieces)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(shared.value)
    return _codecs[key]


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of a batch in chunks of bounded size, with their texts."""
    at = 0
    sizes = np.nan_to_num(batch.column(text).cast(pa.large_string()).cast(pa.large_binary()).to_pandas().str.len().to_numpy(float))
    while at < batch.num_rows:
        room = np.searchsorted(np.cumsum(sizes[at:at + ROWS]), CHARS, "right")
        part = batch.slice(at, max(1, int(room)))
        yield part, part.column(text).to_pylist()
        at += part.num_rows


def with_pieces(docs: DataFrame, model_path: str, text: str = "text", pieces: str = "piece_ids") -> DataFrame:
    """`docs` with the pieces of their texts in an array column (replaced if it exists).

    The model is read on the driver and broadcast; it is a fixed file of less than a MB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    rest = [c for c in docs.columns if c != pieces]
    source = docs.select(*[f"`{c}`" for c in rest])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            for part, texts in _parts(batch, text):
                ids = [ids_of(words) for words in codec.encoded(texts)]
                yield pa.record_batch([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*rest, pieces])

    return source.mapInArrow(encode, with_fields(source, f"`{pieces}` array<int>"))


def with_text(frame: DataFrame, model_path: str, pieces: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """`frame` with the text of its pieces in a column (replaced if it exists); missing pieces give an empty text."""
    shared = frame.sparkSession.sparkContext.broadcast(read_model(model_path))
    rest = [c for c in frame.columns if c != decoded]
    source = frame.select(*[f"`{c}`" for c in rest])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = pa.array([codec.decode(ids or []) for ids in part.column(pieces).to_pylist()], pa.string())
                yield pa.record_batch([*part.columns, texts], names=[*rest, decoded])

    return source.mapInArrow(decode, with_fields(source, f"`{decoded}` string"))


def round_trip(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Encode every text, decode the pieces, and keep only their digests.

    Columns: doc_id, n_tokens, ids_sha256 (decimal pieces joined by commas) and decoded_sha256 (of the text in UTF-8).
    One pass, so that neither pieces nor texts leave the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            for part, texts in _parts(batch, text):
                found = [
                    (
                        sum([w[0] for w in words]),
                        hashlib.sha256(",".join([w[1] for w in words]).encode()).hexdigest(),
                        hashlib.sha256(codec.decoded(words)).hexdigest(),
                    )
                    for words in codec.encoded(texts)
                ]
                count, ids_hash, text_hash = zip(*found, strict=True)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=names
                )

    source = docs.select("doc_id", f"`{text}`")
    schema = with_fields(source.select("doc_id"), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return source.mapInArrow(digest, schema)
