"""Words of a column of texts, found and fingerprinted without one Python object per word.

A batch of texts is one run of UTF-8 bytes with row bounds. Words are maximal runs of bytes of
a class; all classes used here treat a byte above 0x7F like any other byte of its character, so
working on bytes equals working on characters. A missing text has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Texts are handled in pieces of about this many bytes, which bounds the memory of a task; a
# longer text is a piece of its own.
CHUNK_BYTES = 4 << 20
# Fingerprints are summed over runs of about this many bytes.
_RUN_BYTES = 1 << 20

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

# letters a-z (after lower-casing), digits, everything beyond ASCII
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


def with_fields(frame: DataFrame, ddl: str) -> StructType:
    """The columns of a frame and further ones."""
    return StructType([*frame.schema.fields, *StructType.fromDDL(ddl).fields])


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers after which all bits depend on all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pseudo_random(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers for a seed."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9D1B2E6F35A7C8D3
_BYTES = pseudo_random(256, 1)
_LOWER_BYTES = _BYTES[LOWER]
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _power, _inverse
    if len(_power) < n:
        def of(base: int) -> np.ndarray:
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps)
        _power, _inverse = of(_BASE), of(pow(_BASE, -1, 2**64))
    return _power[:n], _inverse[:n]


@dataclass(frozen=True)
class Chunk:
    """Rows `row`, `row + 1`, ... of a batch; `bounds` are their places in `data`."""

    row: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.bounds[row]:self.bounds[row + 1]].tobytes()


@dataclass(frozen=True)
class Words:
    """Byte places of words; those of row r are numbers first[r] to first[r + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A column of texts in chunks of whole rows."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield Chunk(row, raw[bounds[row]:bounds[stop]], bounds[row:stop + 1] - bounds[row])
        row = stop


def lowered(chunk: Chunk) -> Chunk:
    return Chunk(chunk.row, LOWER[chunk.data], chunk.bounds)


def find_words(chunk: Chunk, member: np.ndarray) -> Words:
    """Maximal runs of member bytes; a run ends with its row."""
    size = len(chunk.data)
    inside = member[chunk.data]
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    heads = chunk.bounds[:-1]
    before[heads[heads < size]] = False
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    tails = chunk.bounds[1:] - 1
    after[tails[tails >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, chunk.bounds))


def fingerprints(data: np.ndarray, words: Words, lower: bool = False) -> np.ndarray:
    """One 64-bit number per word, a polynomial of its bytes; equal words get equal numbers."""
    start, end = words.start, words.end
    table = _LOWER_BYTES if lower else _BYTES
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        stop = max(at + 1, int(np.searchsorted(end, low + _RUN_BYTES, "right")))
        high = end[stop - 1]
        power, inverse = _powers(max(_RUN_BYTES, int(high - low)) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * power[:high - low], out=sums[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def sequence_fingerprints(marks: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every `width` numbers in a row; shorter input gives none."""
    n = len(marks) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _powers(max(_RUN_BYTES, len(marks)) + 1)
    sums = np.zeros(len(marks) + 1, np.uint64)
    np.cumsum(marks * power[:len(marks)], out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * inverse[:n])


def row_of_words(words: Words) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
