"""Importance resampling towards a target, over lines that are counted once.

A text's features are its word sequences of one to `longest` words, hashed into buckets. A bucket's gain
says how much more frequent it is in the target than in the documents; a document's weight is the sum of
the gains of its features, and a share of the documents is drawn without replacement by weight and fixed noise.

Newlines cut texts into lines, and a newline is in no word. Texts repeat lines, so every distinct line is
split into words and hashed once: its features count as often as the line occurs, and its weight goes to every
place where it occurs. Sequences across line ends are added separately, from the first and last words of lines.

How the work is spread: lines meet by their text (counted in map tasks first) and are written with their buckets;
a place is a row's number and the 128-bit key of a line. Lines with a thousandth of all places or more (at most a
thousand lines) go to the places by broadcast, the others by a join in which no key is hot. Bucket counts and gains
are one number per bucket. Ranks come from ranges of scores, ordered down to the row's number, and from counts per range.

Defined cases: a missing text has no words, no features, weight 0, and is never drawn if words are required. A missing
doc_id gives noise like an empty one and comes last among ties. Rows that repeat are rows of their own with ranks of
their own. No documents give no rows; a target without words counts as t = T = 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.sources.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of a lower-case text are runs of a-z, digits and what lies beyond ASCII; between them is this.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Lines with one in this many places are broadcast; there are at most as many.
HOT_SHARE = 1000
_POSITION = (1 << 33) - 1  # the place within a partition in Spark's increasing numbers


def words_of(line: Column) -> Column:
    """The words of a lower-case text."""
    return F.filter(F.split(line, BETWEEN), lambda word: word != "")


def lines_of(text: Column) -> Column:
    """The lines of a text in lower case (A-Z only)."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n")


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature), F.lit(buckets)).cast("int")


def _runs(items: Column, size: int) -> Column:
    """All runs of `size` neighbouring items."""
    starts = F.when(F.size(items) >= size, F.sequence(F.lit(1), F.size(items) - (size - 1)))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.slice(items, i, size))


def line_buckets(words: Column, longest: int, buckets: int) -> Column:
    """The buckets of all sequences within a line."""
    longer = [F.transform(_runs(words, size), lambda run: F.array_join(run, " ")) for size in range(2, longest + 1)]
    return F.transform(F.concat(words, *longer), lambda feature: _bucket(feature, buckets))


def crossing_buckets(lines: Column, longest: int, buckets: int) -> Column:
    """The buckets of the sequences that cross a line end.

    Only the first and last `longest - 1` words of a line can be in one. A longer line is cut down to
    them, with a gap between; sequences with a gap or from a single line are left out.
    """
    if longest < 2:
        return F.array().cast("array<int>")
    edge = longest - 1

    def ends(line: Column, number: Column) -> Column:
        words = words_of(line)
        gap = F.array(F.lit(None).cast("string"))
        cut = F.when(F.size(words) > 2 * edge, F.concat(F.slice(words, 1, edge), gap, F.slice(words, -edge, edge)))
        return F.transform(F.coalesce(cut, words), lambda word: F.struct(word.alias("word"), number.alias("line")))

    edges = F.flatten(F.transform(lines, ends))

    def across(run: Column) -> Column:
        apart = F.element_at(run, 1)["line"] != F.element_at(run, -1)["line"]
        return apart & ~F.exists(run, lambda x: x["word"].isNull())

    def hashed(run: Column) -> Column:
        return _bucket(F.array_join(F.transform(run, lambda x: x["word"]), " "), buckets)

    return F.concat(*[F.transform(F.filter(_runs(edges, size), across), hashed) for size in range(2, longest + 1)])


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("key"), F.xxhash64(line, F.lit(1)).alias("check")]


def counted_lines(docs: DataFrame, longest: int, buckets: int, text: str = "text") -> DataFrame:
    """Every distinct line once: key, check, places (how often it occurs), n_words and buckets."""
    lines = docs.select(F.explode(lines_of(F.col(f"`{text}`"))).alias("line")).filter("line != ''")
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("places"))
    split = counted.select(*_key(F.col("line")), "places", words_of(F.col("line")).alias("words"))
    return split.select(
        "key", "check", "places", F.size("words").alias("n_words"), line_buckets(F.col("words"), longest, buckets).alias("buckets")
    )


def bucket_counts(lines: DataFrame, crossing: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket: those of a line as often as it occurs, and those across line ends."""
    inner = lines.select("places", F.explode("buckets").alias("bucket"))
    outer = crossing.select(F.lit(1).cast("bigint").alias("places"), F.explode("crossing").alias("bucket"))
    out = np.zeros(buckets)
    for found in inner.union(outer).groupBy("bucket").agg(F.sum("places").alias("n")).collect():  # a row per bucket
        out[found["bucket"]] = found["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more frequent each bucket is in the target, rounded down."""
    n = len(source)
    all_source, all_target = source.sum() + n, target.sum() + n
    return np.array([
        math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target)))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def _with_weight(frame: DataFrame, column: str, gains: np.ndarray) -> DataFrame:
    """`frame` with n_features and weight in place of an array of buckets; one number per bucket is broadcast."""
    shared = frame.sparkSession.sparkContext.broadcast(gains)
    rest = [c for c in frame.columns if c != column]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            total = np.append(0, np.cumsum(shared.value[lists.flatten().to_numpy(zero_copy_only=False)]))
            end = np.cumsum(size, dtype=np.int64)
            weight = total[end] - total[end - size]
            yield pa.record_batch(
                [*[batch.column(c) for c in rest], pa.array(size, pa.int64()), pa.array(weight, pa.int64())],
                names=[*rest, "n_features", "weight"],
            )

    kept = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in rest)
    return frame.mapInArrow(weigh, f"{kept}, n_features bigint, weight bigint")


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) for every row of `docs`; `target` has its texts in the same column.

    `row` numbers the rows; it is unique and follows no order.
    """
    value = F.col(f"`{text}`")
    rows = written(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lines_of(value).alias("lines")).select(
            "row", "doc_id", crossing_buckets(F.col("lines"), longest, buckets).alias("crossing"),
            F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.struct(*_key(x))).alias("keys"),
        ),
        "weighted-rows",
    )
    lines = written(counted_lines(docs, longest, buckets, text), "weighted-lines")
    aims = target.select(crossing_buckets(lines_of(value), longest, buckets).alias("crossing"))
    gains = bucket_gains(
        bucket_counts(lines, rows, buckets), bucket_counts(counted_lines(target, longest, buckets, text), aims, buckets)
    )
    places = lines.agg(F.sum("places")).first()[0] or 0
    crowded = F.col("places") * HOT_SHARE >= places
    weighed = _with_weight(lines.select("key", "check", "n_words", crowded.alias("hot"), "buckets"), "buckets", gains)
    hot = F.broadcast(weighed.filter("hot"))
    at = rows.select("row", F.explode("keys").alias("k")).select("row", "k.key", "k.check")
    found = [
        at.join(hot, ["key", "check"]),
        at.join(hot, ["key", "check"], "left_anti").join(weighed.filter("NOT hot"), ["key", "check"]),
    ]
    kind = docs.schema["doc_id"].dataType
    alone = _with_weight(rows.select("row", "doc_id", F.lit(0).alias("n_words"), "crossing"), "crossing", gains)
    parts = [alone, *[f.withColumn("doc_id", F.lit(None).cast(kind)) for f in found]]
    columns = ["row", "doc_id", "n_words", "n_features", "weight"]
    return reduce(DataFrame.union, [p.select(*columns) for p in parts]).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).cast("bigint").alias(c) for c in columns[2:]]
    )


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a digest of the seed and the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    place = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((place + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
    seed: int = 2024, text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs`.

    Of the rows with `least_words` words, `percent` of a hundred (rounded down) are drawn: the highest scores, ties to the
    smaller doc_id. Their ranks are 1, 2, 3, ...; the others have none.
    """
    weighed = weights(docs, target, longest, buckets, text)
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored-rows")
    eligible, rest = scored.filter(F.col("n_words") >= least_words), scored.filter(F.col("n_words") < least_words)
    # features before the row's number, so that equal documents have the same ranks in every run
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.asc("row")]
    ranged = eligible.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("place", F.monotonically_increasing_id()), "placed-rows")
    part = F.shiftright("place", 33)
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())  # a row per shuffle partition
    drawn, before, offsets = percent * sum(sizes.values()) // 100, 0, []
    for number in sorted(sizes):
        offsets.append((number, before))
        before += sizes[number]
    offset = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part bigint, before bigint"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit(_POSITION)) + 1
    ranked = placed.withColumn("part", part).join(offset, "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, "rank").union(rest.select(*columns, F.lit(None).cast("bigint").alias("rank")))
