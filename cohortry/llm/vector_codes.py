"""Vector codes: parts of vectors numbered by codebooks that ball k-means trains in whole numbers.

Components become integers, vectors are cut into equal parts, and every part position has a codebook. An
entry and the parts assigned to it form a ball, whose radius is the distance of its farthest part. After a
round's update,

* entries that are at least twice the radius away (a little more than that, so that ties count) are no neighbours of
  a ball and never meet its parts;
* a part nearer to its entry than half the way to the nearest neighbour lies in the stable core and is done;
* any other part lies in an annular ring between halfway distances to neighbours, in order, and is compared with
  the neighbours up to its ring only.

All comparisons are of squared distances in integers, so the assignment equals the one by all distances, ties
to the lower entry included.

How the work is spread: every round is one pass over the vectors, whose tasks return a count and a sum per entry and
component; these are added up by a shuffle of a few rows a task. Codebooks (entries x components) are broadcast.
Assignments are not written: a pass goes through the codebooks so far, each from the balls of the one before, and balls,
their radii and neighbours are taken over a block of rows, which is exact for the rows in it. So no round leaves
anything on disk, and a lost executor repeats its tasks only. Once a round changes no entry, later rounds cannot either.

Defined cases: rows whose vector is missing or holds missing or non-finite components are left out, and so are
vectors of another length than most (the shorter of equally frequent lengths) and vectors with components so
large that squared distances of parts do not fit 64 bits (from 46,340 on for parts of 8 and the factor 4096). If the parts do not divide the length, vectors end in zeros. Rows that repeat are
rows of their own; codebooks start from rows in the order of vec_id (missing last), then of the vector. With fewer rows than entries
there are as many entries as rows. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.skew import lookup_join
from cohortry.sources.shared import written

from .tokens import with_fields

# Rows whose parts are assigned together; balls are taken over them.
BLOCK = 8192


@dataclass(frozen=True)
class Shape:
    """Components per vector, parts, and the factor that makes components whole numbers."""

    length: int
    parts: int
    scale: float

    @property
    def width(self) -> int:
        return -(-self.length // self.parts)

    @property
    def largest(self) -> float:
        """Components below this size keep four times a part's squared distance below 2**62."""
        return float(2 ** 30 / np.sqrt(max(1, self.width)) / (2 * self.scale))


def whole(column: pa.Array, shape: Shape) -> np.ndarray:
    """Vectors as integers: rows x parts x components of a part."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), shape.length)
    out = np.zeros((len(column), shape.parts * shape.width), np.int64)
    out[:, :shape.length] = np.floor(shape.scale * flat)
    return out.reshape(len(column), shape.parts, shape.width)


def _squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((points - entries) ** 2).sum(-1)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every point and its squared distance, by all distances."""
    best = np.zeros(len(points), np.int64)
    distance = _squared(points, entries[0])
    for k in range(1, len(entries)):
        other = _squared(points, entries[k])
        closer = other < distance
        best[closer], distance[closer] = k, other[closer]
    return best, distance


def moved(points: np.ndarray, entries: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from known balls: point i was assigned to entry ball[i] when entries lay elsewhere."""
    best, distance = ball.copy(), _squared(points, entries[ball])
    radius = np.zeros(len(entries), np.int64)
    np.maximum.at(radius, ball, distance)
    apart = ((entries[:, None] - entries[None]) ** 2).sum(-1)
    for own in np.unique(ball).tolist():
        # halfway distances and radii are compared as squares: |a - b| <= 2 r
        near = np.flatnonzero(apart[own] <= 4 * radius[own])
        near = near[near != own]
        near = near[np.argsort(apart[own, near], kind="stable")]
        if not len(near):
            continue
        members = np.flatnonzero(ball == own)
        reach = 4 * distance[members]
        # outside the stable core; a ring ends at the halfway distance to each neighbour
        for other in near.tolist():
            ring = reach >= apart[own, other]
            members, reach = members[ring], reach[ring]
            if not len(members):
                break
            there = _squared(points[members], entries[other])
            closer = (there < distance[members]) | ((there == distance[members]) & (other < best[members]))
            best[members[closer]], distance[members[closer]] = other, there[closer]
    return best, distance


def assigned(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances (rows x parts) under the last of several codebooks (parts x entries x width)."""
    best = np.zeros(vectors.shape[:2], np.int64)
    distance = np.zeros(vectors.shape[:2], np.int64)
    for part in range(vectors.shape[1]):
        points = np.ascontiguousarray(vectors[:, part])
        own, far = nearest(points, books[0][part])
        for book in books[1:]:
            own, far = moved(points, book[part], own)
        best[:, part], distance[:, part] = own, far
    return best, distance


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def usable(vectors: DataFrame, parts: int, scale: float) -> tuple[DataFrame, Shape | None]:
    """Rows that take part, and their shape."""
    finite = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    kept = vectors.filter(F.coalesce(F.expr(finite), F.lit(False)))
    length = kept.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").first()
    if length is None:
        return kept, None
    shape = Shape(length[0], parts, scale)
    fits = F.expr(f"forall(embedding, x -> abs(x) < {shape.largest!r}D)")
    return kept.filter((F.size("embedding") == shape.length) & fits), shape


def _tallied(kept: DataFrame, shape: Shape, books: list[np.ndarray]) -> np.ndarray:
    """The codebook after one more round: sums over all tasks, divided and rounded down."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        parts, entries, width = known[-1].shape
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for block in _blocks(batches):
            vectors = whole(block.column("embedding"), shape)
            best, _ = assigned(vectors, known)
            for part in range(parts):
                own = best[:, part]
                sums[part, :, width] += np.bincount(own, minlength=entries)
                for place in range(width):  # exact: a block's sums stay below 2**53
                    sums[part, :, place] += np.bincount(own, vectors[:, part, place], entries).astype(np.int64)
        flat = sums.reshape(-1)
        place = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(place, pa.int32()), pa.array(flat[place])], names=["place", "n"])

    # a row per entry and component (and count)
    rows = kept.select("embedding").mapInArrow(tally, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    last = books[-1]
    sums = np.zeros(last.size + last.shape[0] * last.shape[1], np.int64)
    for row in rows:
        sums[row["place"]] = row["n"]
    sums = sums.reshape(last.shape[0], last.shape[1], last.shape[2] + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), last)


def train(kept: DataFrame, shape: Shape, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks of all rounds, the first rows' parts first."""
    first = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    if not first.num_rows:
        return []
    start = whole(first.column("embedding").combine_chunks(), shape)
    books = [start.transpose(1, 0, 2).copy()]
    for _ in range(rounds):
        following = _tallied(kept, shape, books)
        if np.array_equal(following, books[-1]):
            break
        books.append(following)
    return books


def encoded(
    vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0
) -> tuple[DataFrame, np.ndarray | None]:
    """The usable rows of `vectors` with `codes` (one byte a part) and `error` as further columns, and the codebook.

    Columns of these names are replaced. The codebook has parts x entries x components; without rows there is none.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    kept, shape = usable(vectors, parts, scale)
    rest = [c for c in vectors.columns if c not in ("codes", "error")]
    source = kept.select(*[f"`{c}`" for c in rest])
    schema = with_fields(source, "codes binary, error bigint")
    books = train(kept, shape, entries, rounds) if shape else []
    if not books:
        return kept.sparkSession.createDataFrame([], schema), None
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            best, distance = assigned(whole(block.column("embedding"), shape), shared.value)
            codes = pa.array([row.tobytes() for row in best.astype(np.uint8)], pa.binary())
            yield pa.record_batch([*block.columns, codes, pa.array(distance.sum(1))], names=[*rest, "codes", "error"])

    return source.mapInArrow(encode, schema), books[-1]


def decoded(codes: np.ndarray, book: np.ndarray, length: int, scale: float = 4096.0) -> np.ndarray:
    """The vectors that codes (rows x parts) stand for."""
    parts = np.arange(book.shape[0])
    return book[parts, codes].reshape(len(codes), -1)[:, :length] / scale


def digest(book: np.ndarray | None) -> str:
    """The SHA-256 of all components of a codebook, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, [] if book is None else book.reshape(-1).tolist())).encode()).hexdigest()


def coded_vectors(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over rows of one label, missing ones together) and
    codebooks_sha256, one row per usable row of `vectors` (vec_id, embedding, label)."""
    found, book = encoded(vectors.select("vec_id", "embedding", "label"), **settings)
    coded = written(found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label"), "vector-codes")
    named = coded.select(
        "vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of")
    )
    sums = named.groupBy("none", "of").agg(F.sum("error").alias("label_error"))
    joined = lookup_join(named, sums, ["none", "of"], "inner")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
