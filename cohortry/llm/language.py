"""Language of a text by cross-parsing entropy.

For every language a suffix automaton of labelled text recognises all its substrings. A text is
parsed against each automaton into phrases, each the longest one that the labelled text contains
(or one unknown byte). The fewer phrases, the better the language describes the text: the
language with the fewest bits per byte, phrases * log2(labelled length) / text length, wins.

Parsing starts anew at every word (with the blanks around it), so the phrases of a word are
counted once per distinct word of a chunk and added up. All words are parsed at once, one byte
per step, by table look-ups.

The labelled text is a bounded sample: up to SAMPLE_BYTES of distinct words over all languages,
taken in order of a hash of the document number and the text, from at most SAMPLE_ROWS different
rows (at least one of each language) and the first SAMPLE_CHARS characters of each. The texts to label are read whole.

Defined cases: a text that is missing or has no letter is `und` with score 0; so is every text if
no labelled row exists. Labels that are missing teach nothing. Ties go to the first language by
name. Repeated rows repeat their result. Words are runs of letters and of bytes beyond ASCII.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as tk

UNKNOWN = "und"
# Bytes of distinct words that all automata together may learn from, and rows of the sample.
SAMPLE_BYTES, SAMPLE_ROWS = 240_000, 2_000
# Characters of a sampled text that may be learned from.
SAMPLE_CHARS = 20_000
FOREIGN = 10.0
# A text is in none of the languages if its phrases under the best of them are shorter than this (in bytes, on average);
# texts of fewer bytes (of words, with a blank on either side) are given the benefit of the doubt.
LEAST_PHRASE, LEAST_JUDGED = 1.5, 32

LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


@dataclass(frozen=True)
class Parser:
    """Automata of all languages over one small alphabet.

    `step[language][state, symbol]` is the next state or -1; state 0 is the empty string and the
    last state follows an unknown symbol.
    """

    names: list[str]
    symbol: np.ndarray
    step: list[np.ndarray]
    bits: np.ndarray


def suffix_automaton(words: list[bytes], symbol: np.ndarray, symbols: int) -> np.ndarray:
    """The transitions of the generalised suffix automaton of ` word ` for all words."""
    moves: list[dict[int, int]] = [{}]
    length, link = [0], [-1]

    def extend(last: int, c: int) -> int:
        known = moves[last].get(c)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return split(last, c, known)
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
            link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
        return new

    def split(p: int, c: int, q: int) -> int:
        clone = len(moves)
        moves.append(dict(moves[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = clone
            p = link[p]
        return clone

    for word in words:
        last = 0
        for byte in b" " + word + b" ":
            last = extend(last, int(symbol[byte]))
    step = np.full((len(moves) + 1, symbols + 1), -1, np.int32)
    for state, own in enumerate(moves):
        for c, to in own.items():
            step[state, c] = to
    return step


def train(labelled: list[tuple[str, str]], sample_bytes: int = SAMPLE_BYTES) -> Parser:
    """Automata from (language, text) rows; each language may learn from an equal share of the bytes.

    Words that are FOREIGN times as frequent in another language are left out: they stand in
    quotations, names and notices.
    """
    names = sorted({name for name, _ in labelled})
    found: dict[str, tuple[list[bytes], np.ndarray, np.ndarray]] = {}
    for name in names:
        chunk = tk.lowered(next(tk.chunks(pa.array(["\n".join(text for other, text in labelled if other == name)]))))
        words = tk.find_words(chunk, LETTERS)
        marks, first, count = np.unique(tk.fingerprints(chunk.data, words), return_index=True, return_counts=True)
        order = np.argsort(first)
        spelled = [chunk.data[words.start[i]:words.end[i]].tobytes() for i in first[order].tolist()]
        found[name] = spelled, marks[order], count[order] / max(1, count.sum())
    highest: dict[int, float] = {}
    for _, marks, rate in found.values():
        for mark, share in zip(marks.tolist(), rate.tolist(), strict=True):
            highest[mark] = max(share, highest.get(mark, 0.0))
    kept: list[list[bytes]] = []
    for spelled, marks, rate in found.values():
        left, own = sample_bytes // len(names), []
        for word, mark, share in zip(spelled, marks.tolist(), rate.tolist(), strict=True):
            if share * FOREIGN >= highest[mark] and len(word) + 2 <= left:
                left -= len(word) + 2
                own.append(word)
        kept.append(own)
    used = sorted({b" "[0], *(byte for own in kept for word in own for byte in word)})
    symbol = np.full(256, len(used), np.int32)
    symbol[used] = np.arange(len(used))
    sizes = [max(2, sum(len(w) + 2 for w in own)) for own in kept]
    return Parser(names, symbol, [suffix_automaton(own, symbol, len(used)) for own in kept], np.log2(np.array(sizes, float)))


def phrases(parser: Parser, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Phrases of each word (one row) in each language (one column)."""
    order = np.argsort(start - end, kind="stable")  # longest first
    start, length = start[order], (end - start)[order]
    out = np.ones((len(order), len(parser.names)), np.int64)
    blank = parser.symbol[0x20]
    steps = int(length[0]) + 1 if len(length) else 0
    for k, step in enumerate(parser.step):
        lost = len(step) - 1
        state = np.full(len(order), step[0, blank], np.int32)
        state[state < 0] = lost
        for i in range(steps):
            inside = np.searchsorted(-length, -i, "left")  # words longer than i
            ending = np.searchsorted(-length, -i, "right")  # words of i bytes and more
            c = np.full(ending, blank, np.int32)
            c[:inside] = parser.symbol[data[start[:inside] + i]]
            to = step[state[:ending], c]
            new = to < 0
            if new.any():
                fresh = step[0, c[new]]
                to[new] = np.where(fresh < 0, lost, fresh)
                out[:ending, k] += new
            state = to
    result = np.empty_like(out)
    result[order] = out
    return result


def scores(parser: Parser, chunk: tk.Chunk) -> tuple[list[str], list[float], list[float], list[float], list[int]]:
    """Language, margin, bits per byte, bytes per phrase and bytes parsed of each row of a chunk of lower-cased texts."""
    words = tk.find_words(chunk, LETTERS)
    total = np.zeros((chunk.rows, len(parser.names)))
    size = np.zeros(chunk.rows)
    if len(words) and parser.names:
        marks = tk.fingerprints(chunk.data, words)
        _, at, back = np.unique(marks, return_index=True, return_inverse=True)
        counts = phrases(parser, chunk.data, words.start[at], words.end[at])[back]
        rows = tk.row_of_words(words)
        for k in range(len(parser.names)):
            total[:, k] = np.bincount(rows, counts[:, k], chunk.rows)
        size = np.bincount(rows, words.end - words.start + 2, chunk.rows)
    names, margin, bits, length = [], [], [], []
    for row in range(chunk.rows):
        if not size[row] or not has_letter(chunk.text(row)):
            names.append(UNKNOWN)
            margin.append(0.0)
            bits.append(math.inf)
            length.append(0.0)
            continue
        cost = total[row] * parser.bits / size[row]
        best = int(np.argmin(cost))
        rest = np.delete(cost, best)
        names.append(parser.names[best])
        margin.append(float(1 - cost[best] / rest.min()) if len(rest) else 1.0)
        bits.append(float(cost[best]))
        length.append(float(size[row] / total[row, best]))
    return names, margin, bits, length, size.astype(int).tolist()


_ASCII_LETTERS = bytes(range(0x61, 0x7B))


def has_letter(text: bytes) -> bool:
    """Whether a lower-cased text holds a letter of any script."""
    return len(text) != len(text.translate(None, _ASCII_LETTERS)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def training_sample(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most `rows` labelled texts (or one for each language), in a fixed order.

    Each language keeps the rows with the smallest hashes, repeated rows once; the hashes are ranked
    first, so that no more texts than these reach the driver.
    """
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    languages = labelled.select("lang").distinct().count()
    if not languages:
        return []
    place = F.xxhash64("doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    first = labelled.select("lang", place.alias("place")).repartition("lang", "place").distinct().withColumn("rank", rank).filter(F.col("rank") <= max(1, rows // languages))
    last = {r["lang"]: r["last"] for r in first.groupBy("lang").agg(F.max("place").alias("last")).collect()}
    bound = F.create_map(*[F.lit(x) for pair in sorted(last.items()) for x in pair])
    kept = labelled.withColumn("place", place).filter(F.col("place") <= bound[F.col("lang")])
    found = kept.groupBy("lang", "place").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    ordered = sorted(found.collect(), key=lambda r: (r["place"], r["lang"]))
    return [(r["lang"], r["text"]) for r in ordered]


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """`docs` (columns doc_id and text) with lang_pred, score (0 to 1: the margin to the next
    language) and bits (per byte under the predicted language; infinite for `und`)."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    names = ["doc_id", "lang_pred", "score", "bits"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for chunk in tk.chunks(batch.column("text")):
                found = scores(own, tk.lowered(chunk))[:3]
                ids = batch.column("doc_id").slice(chunk.row, chunk.rows)
                yield pa.record_batch([ids, *map(pa.array, found)], names=names)

    source = docs.select("doc_id", "text")
    schema = tk.with_fields(source.select("doc_id"), "lang_pred string, score double, bits double")
    return source.mapInArrow(label, schema)


def accepted(docs: DataFrame, parser: Parser, least_phrase: float = LEAST_PHRASE, least: int = LEAST_JUDGED) -> DataFrame:
    """The rows of `docs` whose text is in one of the languages; all columns stay.

    A text without a letter goes, and so does one of `least` bytes or more whose phrases under its best language are
    shorter than `least_phrase` bytes, such as a text in a script that none of them uses. A parser that has learned nothing rejects only texts without a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for chunk in tk.chunks(batch.column(place)):
                low = tk.lowered(chunk)
                if own.names:
                    names, _, _, length, size = scores(own, low)
                    good = [n != UNKNOWN and (b >= least_phrase or k < least) for n, b, k in zip(names, length, size, strict=True)]
                else:
                    good = [has_letter(low.text(r)) for r in range(low.rows)]
                kept[chunk.row:chunk.row + chunk.rows] = good
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
