"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, where u is
a hash of the row's key and the child's path, and the smallest draw wins; so a child is chosen
with probability weight / sum of weights. A change of weights moves rows only into or out of
subtrees whose weight changed: draws of all other children stay as they are.

An additional shard that is to take rows only into itself comes as a region of its own
(`grown`). Put into an existing rack, its weight also counts for the rack and the region, and the
movement stays within that region plus the rows that enter it.

Slots number the rows of a shard without gaps. They are row numbers within one of BLOCKS blocks
per shard, plus the rows of the blocks before; so no task sees a whole shard.

Defined cases: a missing key hashes like the text `null`; a missing text has no bytes; equal
rows get slots next to each other. Weights must not be negative; a child of weight 0 gets no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# weights of shards, by region and rack
Tree = Sequence[Sequence[Sequence[float]]]

# Blocks of a shard: three hexadecimal digits of a hash.
BLOCK_DIGITS = 3
# Bytes that a row costs besides its text.
ROW_BYTES = 16


def uniform(regions: int, racks: int, shards: int) -> Tree:
    return [[[1.0] * shards] * racks] * regions


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, as a region of its own."""
    return [*tree, [[weight]]]


def _nested(value) -> Column:
    return F.array(*map(_nested, value)) if isinstance(value, (list, tuple)) else F.lit(value)


def _draw(path: Column, weights: Column) -> Column:
    """The number of the child with the smallest draw; ties go to the first."""
    def one(weight: Column, child: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws("/", path, child.cast("string"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        score = F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))
        return F.struct(score.alias("score"), child.alias("child"))

    return F.array_min(F.transform(weights, one))["child"]


def place(rows: DataFrame, key: Column, tree: Tree, into: str) -> DataFrame:
    """`rows` with the number of their shard; shards are numbered in order of the tree."""
    if not any(weight > 0 for region in tree for rack in region for weight in rack):
        raise ValueError("no shard has a positive weight")
    tree = [[[float(weight) for weight in rack] for rack in region] for region in tree]
    first, n = [], 0
    for region in tree:
        first.append([])
        for rack in region:
            first[-1].append(n)
            n += len(rack)
    region_weights = _nested([sum(map(sum, region)) for region in tree])
    rack_weights = _nested([[sum(rack) for rack in region] for region in tree])
    names = [f"__{level}_{into}" for level in ("key", "region", "rack", "shard")]
    path, region, rack, shard = (F.col(f"`{x}`") for x in names)
    return (
        rows.withColumn(names[0], key)
        .withColumn(names[1], _draw(path, region_weights))
        .withColumn(names[2], _draw(F.concat_ws("/", path, region.cast("string")), F.get(rack_weights, region)))
        .withColumn(
            names[3],
            _draw(F.concat_ws("/", path, region.cast("string"), rack.cast("string")), F.get(F.get(_nested(tree), region), rack)),
        )
        .withColumn(into, (F.get(F.get(_nested(first), region), rack) + shard).cast("int"))
        .drop(*names)
    )


def shard_rows(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, size, text_crc32, law (`key`), shard, slot and grown_shard for every row of `docs`."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    block = F.conv(F.substring(F.md5(key), 1, BLOCK_DIGITS), 16, 10).cast("int")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = place(
        place(
            docs.select(
                "doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
            ),
            key, tree, "shard",
        ),
        key, grown(tree), "grown_shard",
    ).withColumn("block", block)
    counts = place(docs.select("doc_id"), key, tree, "shard").groupBy("shard", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("number") - 1).cast("bigint").alias("slot"), "grown_shard",
    )
