"""Near-duplicate vectors by an inverted multi-index.

Each half of a unit vector has its own codebook; the pairs of code words form a grid of cells. A
vector lies in the cell of its nearest code words. To find its neighbours it visits cells in
order of their distance, the sum of both halves' squared distances (multi-sequence: a heap that
goes on from a visited cell to the next code word of either half), until the distance exceeds
that of its own cell by a margin. All vectors of a visited cell are verified in double precision.

The margin is what a target recall needs: samples of vectors are compared with all rows by brute
force until PROBES of them have a neighbour, and the margin is a quantile, over these vectors, of the
distance at which the last of their true neighbours would be met. If neighbours are too rare for that,
the margin is one at which no pair can be missed. The codebooks are trained on another bounded sample. Every row is indexed.

Equal vectors form a class and are compared once. Cells are cut into blocks, and so are the
vectors that visit them, so a crowded cell becomes many tasks of bounded size.

Defined cases: missing or zero vectors, vectors with missing or non-finite components, and
vectors of another length than most link with nothing. Rows that repeat a vec_id and its vector
are one vector; a vec_id with several vectors gives one row for each. Rows without vec_id link
with nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.shared import written

from . import tokens as tk
from .graph import connected_components

# Code words per half, vectors they are trained on, and rounds of training.
WORDS, TRAINED_ON, TRAINING_ROUNDS = 32, 20_000, 12
# Vectors with a neighbour that set the margin, and the recall aimed at.
PROBES, TARGET_RECALL = 256, 0.995
# Vectors compared with all rows in one pass, and passes.
MOST_PROBES, MOST_PASSES = 16_384, 8
# Vectors per block of a cell, on either side.
BLOCK = 2000


@dataclass(frozen=True)
class Grid:
    """Code words of both halves."""

    left: np.ndarray
    right: np.ndarray

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves to all code words."""
        half = self.left.shape[1]
        return _squared(unit[:, :half], self.left), _squared(unit[:, half:], self.right)

    def visits(self, d1: np.ndarray, d2: np.ndarray, margin: float) -> list[int]:
        """Cells by distance, from the vector's own one to `margin` beyond."""
        one, two = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        a, b = d1[one].tolist(), d2[two].tolist()
        limit, width = a[0] + b[0] + margin, len(two)
        heap, seen, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
        while heap:
            distance, i, j = heapq.heappop(heap)
            if distance > limit:
                break
            out.append(one[i] * width + two[j])
            for following in ((i + 1, j), (i, j + 1)):
                if following not in seen and following[0] < len(one) and following[1] < width:
                    seen.add(following)
                    heapq.heappush(heap, (a[following[0]] + b[following[1]], *following))
        return out


def _squared(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1)


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Arrays of floats, all of one length, as unit vectors in double precision."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1)
    # scaled first, so that squares neither vanish nor overflow
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def codebook(points: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Code words by k-means from a fixed start."""
    points = np.unique(points, axis=0)
    pick = np.argsort(tk.pseudo_random(len(points), seed))[:words]
    centre = points[pick]
    for _ in range(TRAINING_ROUNDS):
        near = _squared(points, centre).argmin(1)
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, points)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def _sample(classes: DataFrame, low: float, high: float, salt: int) -> np.ndarray:
    """The vectors whose hash lies in a share [low, high) of all hashes."""
    place = F.pmod(F.xxhash64("vec", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    found = classes.filter((place >= low) & (place < high)).select("embedding").toArrow().column("embedding").combine_chunks()
    return unit_vectors(found) if len(found) else np.empty((0, 0))


def train(classes: DataFrame, n: int) -> Grid:
    # a sample without vectors would have no code words
    share, sample = min(1.0, TRAINED_ON / max(n, 1)), np.empty((0, 0))
    while not len(sample):
        sample, share = _sample(classes, 0.0, share, 1), min(1.0, 2 * share)
    half = sample.shape[1] // 2
    return Grid(codebook(sample[:, :half], WORDS, 2), codebook(sample[:, half:], WORDS, 3))


def needed_margin(classes: DataFrame, n: int, grid: Grid, least: float, recall: float) -> float:
    """The margin at which a share `recall` of the vectors with neighbours meet all of them.

    Measured on PROBES such vectors, or on all there are once every vector was compared.
    """
    gaps: list[float] = []
    low, rows = 0.0, PROBES
    for _ in range(MOST_PASSES):
        high = min(1.0, low + rows / max(n, 1))
        gaps += _widest_gaps(classes, grid, _sample(classes, low, high, 4), least)
        if len(gaps) >= PROBES or high >= 1:
            return max(0.0, float(np.quantile(gaps, recall, method="higher"))) + 1e-9 if gaps else 0.0
        low, rows = high, min(MOST_PROBES, 8 * rows)
    return safe_margin(grid, least)


def safe_margin(grid: Grid, least: float) -> float:
    """A margin at which no pair is missed.

    For x and y in the cells of code words a and b, the distances beyond their own cells at which
    they meet the other's cell add up to 2 (x - y)(a - b), so the smaller one is at most |x - y| |a - b|.
    """
    widest = sum(max(0.0, float(_squared(words, words).max())) for words in (grid.left, grid.right))
    return float(np.sqrt(max(0.0, 2 - 2 * least) * widest)) + 1e-9


def _widest_gaps(classes: DataFrame, grid: Grid, probes: np.ndarray, least: float) -> list[float]:
    """For each probe that has neighbours, the margin at which it meets the last of them."""
    if not len(probes):
        return []
    shared = classes.sparkSession.sparkContext.broadcast((grid, probes))

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, probe = shared.value
        p1, p2 = own.distances(probe)
        p_cell = p1.argmin(1), p2.argmin(1)
        p_base = p1.min(1) + p2.min(1)
        # the widest gap of each probe in this task
        gap = np.full(len(probe), -1.0)
        size = max(1, BLOCK * PROBES // len(probe))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                unit = unit_vectors(batch.column("embedding").slice(at, size))
                d1, d2 = own.distances(unit)
                i, j = d1.argmin(1), d2.argmin(1)
                near = unit @ probe.T
                row, k = np.nonzero((near >= least) & (near < 1 - 1e-12))
                from_probe = p1[k, i[row]] + p2[k, j[row]] - p_base[k]
                from_row = d1[row, p_cell[0][k]] + d2[row, p_cell[1][k]] - d1[row, i[row]] - d2[row, j[row]]
                # rounding may leave a gap of zero slightly below it
                np.maximum.at(gap, k, np.maximum(0.0, np.minimum(from_probe, from_row)))
        met = np.flatnonzero(gap >= 0)
        yield pa.record_batch([pa.array(met, pa.int32()), pa.array(gap[met])], names=["probe", "gap"])

    widest = classes.select("embedding").mapInArrow(gaps, "probe int, gap double").groupBy("probe").agg(F.max("gap").alias("gap"))
    found = [r["gap"] for r in widest.collect()]
    shared.unpersist()
    return found


def near_vectors(
    vectors: DataFrame, least: float = 0.9, recall: float = TARGET_RECALL, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector of `vectors` (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding").distinct()
    sound = F.expr(
        "vec_id IS NOT NULL AND embedding IS NOT NULL"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(embedding, x -> x != 0)"
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    lengths = rows.filter("sound").groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    if common is None or common["d"] < 2:
        return _result(rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    known = rows.filter(F.col("sound") & (F.size("embedding") == common["d"]))
    classes = written(
        known.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("n")), "vector-classes"
    )
    n = classes.count()
    grid = train(classes, n)
    margin = needed_margin(classes, n, grid, least, recall)
    links = written(_links(classes, grid, margin, least, block), "vector-links")

    both = links.union(links.select("b", "a")).select(F.col("a").alias("vec"), F.col("b").alias("other"))
    sizes = classes.select(F.col("vec").alias("other"), "n")
    linked = both.join(sizes, "other").groupBy("vec").agg(F.sum("n").alias("others"))
    labels = connected_components(links).withColumnRenamed("id", "vec")
    found = classes.join(linked, "vec", "left").join(labels, "vec", "left").select(
        "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "vec").alias("component_id"),
    )
    matched = known.select("vec_id", "embedding").join(found, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("sound") | (F.size("embedding") != common["d"])).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return _result(matched.union(alone))


def _result(found: DataFrame) -> DataFrame:
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _indexed(classes: DataFrame, grid: Grid, margin: float) -> DataFrame:
    """vec, its unit vector, its cell and the cells it visits."""
    shared = classes.sparkSession.sparkContext.broadcast(grid)
    names = ["vec", "unit", "cell", "visits"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                unit = unit_vectors(part.column("embedding"))
                d1, d2 = own.distances(unit)
                visits = [own.visits(x, y, margin) for x, y in zip(d1, d2, strict=True)]
                yield pa.record_batch(
                    [
                        part.column("vec"), pa.array([x.tobytes() for x in unit], pa.binary()),
                        pa.array([v[0] for v in visits], pa.int32()), pa.array(visits, pa.list_(pa.int32())),
                    ],
                    names=names,
                )

    source = classes.select("vec", "embedding")
    return source.mapInArrow(index, tk.with_fields(source.select("vec"), "unit binary, cell int, visits array<int>"))


def _blocks(cells: DataFrame, into: str, block: int) -> DataFrame:
    """Number of blocks of each cell; at most WORDS**2 rows."""
    return cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(into))


def _links(classes: DataFrame, grid: Grid, margin: float, least: float, block: int) -> DataFrame:
    """Verified pairs of classes, a < b."""
    indexed = written(_indexed(classes, grid, margin), "vector-index")
    visitors = indexed.select("vec", "unit", F.explode("visits").alias("cell"))
    sizes = _blocks(indexed, "p_blocks", block).join(_blocks(visitors, "q_blocks", block), "cell")
    sizes = F.broadcast(sizes)  # a row per cell of the grid
    spread = F.xxhash64("vec")
    points = indexed.join(sizes, "cell").select(
        "vec", "unit", "cell", F.pmod(spread, "p_blocks").cast("int").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"),
    )
    queries = visitors.join(sizes, "cell").select(
        "vec", "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)).alias("p"),
        F.pmod(spread, "q_blocks").cast("int").alias("q"),
    ).toDF("other", "there", "cell", "p", "q")  # columns of their own

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], left.schema.field("vec").type), "b": pa.array([], left.schema.field("vec").type)})
        if not left.num_rows or not right.num_rows:
            return empty
        x, y = _matrix(left.column("unit")), _matrix(right.column("there"))
        v, w = left.column("vec").to_numpy(), right.column("other").to_numpy()
        i, j = np.nonzero(x @ y.T >= least)
        a, b = np.minimum(v[i], w[j]), np.maximum(v[i], w[j])
        apart = a < b
        return pa.table({"a": pa.array(a[apart], empty.schema.field("a").type), "b": pa.array(b[apart], empty.schema.field("b").type)})

    keys = ["cell", "p", "q"]
    kind = classes.schema["vec"].dataType.simpleString()
    return points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)
