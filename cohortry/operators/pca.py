"""Principal components, scores and covariances of a numeric feature column.

The scatter matrix is cut into square blocks of features. Every task adds up the blocks of its rows, around
the mean of its own rows, and hands on each block once; blocks are added in a tree of two levels, means and all, so
neither the shuffle nor a task's memory grows with the rows. The number of tasks follows the cores of the
cluster, not the files of the table.

Up to WIDEST features the whole matrix is decomposed. For more, a randomised range finder (Halko, Martinsson and Tropp)
looks for the first components only: a few passes, each of which multiplies the rows with some vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Features of a block; features whose whole matrix is decomposed on the driver (128 MB).
BLOCK, WIDEST = 512, 4096
# Bytes of rows that a task holds as a matrix at a time.
ROW_BYTES = 32 << 20
# Further vectors and passes of the range finder, and the seed of its first vectors.
OVERSAMPLED, PASSES, SEED = 10, 4, 17

# Of some rows: their number, the means of two blocks of features, and the scatter of these around the means.
Sums = tuple[int, np.ndarray, np.ndarray]
_SUMS = "i int, j int, n bigint, rows int, data binary, task int"


@dataclass(frozen=True)
class Components:
    """Fitted components: rows of `components` are unit vectors, largest variance first.

    The sign of a component is arbitrary; here its largest loading is positive.
    """

    mean: np.ndarray
    components: np.ndarray
    ratios: np.ndarray

    def spectrum(self, spark) -> DataFrame:
        """(component, ratio, cumulative): at most one row per feature."""
        total = np.cumsum(self.ratios)
        rows = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(self.ratios, total))]
        return spark.createDataFrame(rows, "component int, ratio double, cumulative double")

    def loadings(self, spark) -> DataFrame:
        """(component, feature, loading)."""
        rows = [(i + 1, j, float(v)) for i, row in enumerate(self.components) for j, v in enumerate(row)]
        return spark.createDataFrame(rows, "component int, feature int, loading double")


def _arrays(df: DataFrame, features: str) -> Column:
    """The features as an array of doubles, NULL where an element is missing or not finite."""
    x = F.col(features)
    x = (x if df.schema[features].dataType.typeName() == "array" else vector_to_array(x)).cast("array<double>")
    return F.when(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), x)


def pca_fit(df: DataFrame, features: str, n_components: int | float | None = None, widest: int = WIDEST) -> Components:
    """Fit components on centred features.

    None keeps min(rows, features) components, a whole number that many, and a fraction between
    0 and 1 the fewest whose variance ratios add up to more than it. No rows have no components. Up to `widest` features
    one pass is enough, and features x features numbers reach the driver. More features need a whole number of components,
    which are approximate where variances hardly decrease; (components + 10) x features numbers reach the driver.
    Rows with a missing or non-finite element are left out.
    """
    data = _known(df, features)
    first = data.select(F.size("x").alias("n")).first()
    width = first[0] if first else 0
    if width > widest:
        return _by_range_finder(data, width, n_components)
    n, mean, scatter = _whole_scatter(data, width)
    most = min(n, width)
    if n_components is not None and not (
        0 < n_components < 1 or (float(n_components).is_integer() and 1 <= n_components <= most)
    ):
        raise ValueError(f"n_components is None, a fraction or a whole number up to {most}")
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    ratios = values / values.sum() if values.sum() > 0 else values
    if n_components is None:
        k = most
    elif n_components < 1:
        k = min(int(np.searchsorted(np.cumsum(ratios), n_components, side="right")) + 1, most)
    else:
        k = int(n_components)
    return Components(mean, _signed(vectors[:k]), ratios[:k])


def _signed(components: np.ndarray) -> np.ndarray:
    """Every component with a positive largest loading."""
    if not components.size:
        return components
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])
    signs[signs == 0] = 1.0
    return components * signs[:, None]


def pca_scores(df: DataFrame, fitted: Components, features: str, keep: list[str]) -> DataFrame:
    """The kept columns and one score column pc1, pc2, ... per component; NULL without features."""
    names = [f"pc{i + 1}" for i in range(len(fitted.ratios))]
    source = df.select(*keep, _arrays(df, features).alias("__x"))
    turn, mean = fitted.components.T, fitted.mean

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            known = column.is_valid().to_numpy(zero_copy_only=False)
            scores = np.zeros((batch.num_rows, len(names)))
            scores[known] = (_matrix(column.drop_null(), len(mean)) - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(s, mask=~known) for s in scores.T)], names=[*keep, *names]
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"{n} double" for n in names)])
    return source.mapInArrow(project, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if len(column) and (lengths["min"] != width or lengths["max"] != width):
        raise ValueError("feature vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _known(df: DataFrame, features: str) -> DataFrame:
    return df.select(_arrays(df, features).alias("x")).filter(F.col("x").isNotNull())


def _row_blocks(batches: Iterable[pa.RecordBatch], width: int | None = None) -> Iterator[np.ndarray]:
    """The rows of a task as matrices of bounded size, all of one width."""
    for batch in batches:
        column, at = batch.column(0), 0
        while at < len(column):
            if width is None:
                width = len(column[at])
            size = max(1, ROW_BYTES // (8 * max(1, width)))
            yield _matrix(column.slice(at, size), width)
            at += size


def _spans(width: int) -> list[tuple[int, int]]:
    return [(at, min(width, at + BLOCK)) for at in range(0, width, BLOCK)] or [(0, 0)]


def _merged(one: Sums, two: Sums, rows: int) -> Sums:
    """Sums over two sets of rows; the first `rows` means are those of the matrix's rows."""
    if one[2].shape != two[2].shape:
        raise ValueError("feature vectors differ in length")
    n = one[0] + two[0]
    apart = two[1] - one[1]
    scatter = one[2] + two[2] + np.outer(apart[:rows], apart[rows:]) * (one[0] * two[0] / n)
    return n, one[1] + apart * (two[0] / n), scatter


def _added(table: pa.Table) -> pa.Table:
    """All sums of one block of features in one row."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    total = None
    for n, rows, data in zip(table["n"].to_pylist(), table["rows"].to_pylist(), table["data"], strict=True):
        flat = np.frombuffer(data.as_buffer(), np.float64)
        columns = (len(flat) - rows) // (rows + 1)
        own = n, flat[:rows + columns], flat[rows + columns:].reshape(rows, columns)
        total = own if total is None else _merged(total, own, rows)
    return _rows_of([(i, j, total)], table["task"][0].as_py())


def _rows_of(found: Iterable[tuple[int, int, Sums]], task: int) -> pa.Table:
    found = list(found)
    return pa.table({
        "i": pa.array([i for i, _, _ in found], pa.int32()), "j": pa.array([j for _, j, _ in found], pa.int32()),
        "n": pa.array([n for _, _, (n, _, _) in found], pa.int64()),
        "rows": pa.array([len(scatter) for _, _, (_, _, scatter) in found], pa.int32()),
        "data": pa.array([np.append(means, scatter.reshape(-1)).tobytes() for _, _, (_, means, scatter) in found], pa.binary()),
        "task": pa.array([task] * len(found), pa.int32()),
    })


def _few_tasks(data: DataFrame) -> tuple[DataFrame, int]:
    """The same rows in no more tasks than twice the cores, without a shuffle, and the groups of a tree over them."""
    tasks = 2 * data.sparkSession.sparkContext.defaultParallelism
    return data.coalesce(tasks), max(1, ceil(isqrt(tasks)))


def _scatter_blocks(data: DataFrame) -> DataFrame:
    """(i, j, n, rows, data, task): per pair of feature blocks i <= j, starting at these features, rows, means and scatter."""
    few, groups = _few_tasks(data)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _row_blocks(batches):
            mean = x.mean(axis=0)
            x = x - mean
            own = len(x), np.append(mean, mean), x.T @ x
            total = own if total is None else _merged(total, own, len(mean))
        if total is None:
            return
        n, mean, scatter = total[0], total[1][:len(total[2])], total[2]
        task = TaskContext.get().partitionId()
        spans = _spans(len(mean))
        for a, (i, to) in enumerate(spans):  # a block at a time
            for j, end in spans[a:]:
                yield from _rows_of([(i, j, (n, np.append(mean[i:to], mean[j:end]), scatter[i:to, j:end]))], task).to_batches()

    parts = few.mapInArrow(partial, _SUMS)
    if groups > 8:  # few tasks are added up in one step
        parts = parts.groupBy("i", "j", F.pmod("task", F.lit(groups))).applyInArrow(_added, _SUMS)
    return parts.groupBy("i", "j").applyInArrow(_added, _SUMS)


def _whole_scatter(data: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and the scatter matrix, for a width of a checked size."""
    n, mean, scatter = 0, np.zeros(width), np.zeros((width, width))
    for r in _scatter_blocks(data).collect():  # features x features numbers
        flat, n = np.frombuffer(r["data"], np.float64), r["n"]
        i, j, rows = r["i"], r["j"], r["rows"]
        columns = (len(flat) - rows) // (rows + 1)
        if i + rows > width or j + columns > width:
            raise ValueError("feature vectors differ in length")
        mean[i:i + rows] = flat[:rows]
        block = flat[rows + columns:].reshape(rows, columns)
        scatter[i:i + rows, j:j + columns] = block
        scatter[j:j + columns, i:i + rows] = block.T
    return n, mean, scatter


def _summed(data: DataFrame, width: int, per_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a matrix over all blocks of rows, in slices of rows of the matrix, by the same tree."""
    few, groups = _few_tasks(data)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _row_blocks(batches, width):
            own = per_block(x)
            total = own if total is None else total + own
        if total is not None:
            task = TaskContext.get().partitionId()
            for i, to in _spans(len(total)):
                yield pa.record_batch(
                    [pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([total[i:to].tobytes()], pa.binary())],
                    names=["i", "task", "data"],
                )

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(data.as_buffer(), np.float64) for data in table["data"])
        return pa.table({"i": table["i"][:1], "task": table["task"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    schema = "i int, task int, data binary"
    parts = few.mapInArrow(partial, schema)
    if groups > 8:
        parts = parts.groupBy("i", F.pmod("task", F.lit(groups))).applyInArrow(added, schema)
    found = sorted(parts.groupBy("i").applyInArrow(added, schema).collect(), key=lambda r: r["i"])
    return np.concatenate([np.frombuffer(r["data"], np.float64) for r in found])


def _by_range_finder(data: DataFrame, width: int, n_components: int | float | None) -> Components:
    """The first components of many features, from the range of the scatter matrix times some vectors."""
    if n_components is None or not float(n_components).is_integer() or n_components < 1:
        raise ValueError(f"{width} features need a whole number of components")
    # rows, sums and squares per feature; a shift keeps squares small
    shift = np.array(data.first()["x"])
    sums = _summed(data, width, lambda x: np.column_stack([
        np.full(width, float(len(x))), (x - shift).sum(axis=0), ((x - shift) ** 2).sum(axis=0)
    ])).reshape(width, 3)
    n = int(sums[0, 0])
    mean = shift + sums[:, 1] / n
    variance = float((sums[:, 2] - sums[:, 1] ** 2 / n).sum())
    k = int(n_components)
    if k > min(n, width):
        raise ValueError(f"n_components is a whole number up to {min(n, width)}")
    vectors = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, min(width, k + OVERSAMPLED))))[0]
    shared = data.sparkSession.sparkContext.broadcast
    for _ in range(PASSES):
        known = shared((mean, vectors))

        def times(x: np.ndarray, known=known) -> np.ndarray:
            centre, turn = known.value
            centred = x - centre
            return centred.T @ (centred @ turn)

        vectors = np.linalg.qr(_summed(data, width, times).reshape(width, -1))[0]
    known = shared((mean, vectors))

    def within(x: np.ndarray) -> np.ndarray:
        centre, turn = known.value
        projected = (x - centre) @ turn
        return projected.T @ projected

    values, turn = np.linalg.eigh(_summed(data, width, within).reshape(vectors.shape[1], -1))
    values, components = np.maximum(values[::-1][:k], 0.0), (vectors @ turn[:, ::-1][:, :k]).T
    return Components(mean, _signed(components), values / variance if variance > 0 else 0 * values)


def covariance(df: DataFrame, features: str) -> DataFrame:
    """Sample covariance of every pair of features: (i, j, cov) with i <= j.

    Rows with a missing vector, or a missing or non-finite element, are left out.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flat, rows = np.frombuffer(r["data"], np.float64), r["rows"]
                columns = (len(flat) - rows) // (rows + 1)
                i, j = np.divmod(np.arange(rows * columns), columns)
                keep = i + r["i"] <= j + r["j"]
                cov = flat[rows + columns:][keep] / (r["n"] - 1) if r["n"] > 1 else np.full(keep.sum(), np.nan)
                yield pa.record_batch(
                    [pa.array(i[keep] + r["i"], pa.int32()), pa.array(j[keep] + r["j"], pa.int32()), pa.array(cov)], names=["i", "j", "cov"]
                )

    return _scatter_blocks(_known(df, features)).mapInArrow(listed, "i int, j int, cov double")
