"""Updates of stored tables: rewrite the partitions that change, leave the others alone.

A table is a folder of parquet files, partitioned by some columns. An update is a function that gives every row
its new values and says whether it changed them. Two passes: the first finds the partitions with changed rows;
the second computes these only, and writes them to a staging folder. Nothing of the table has changed until then.
The staged rows then replace their partitions (dynamic partition overwrite): Spark moves each partition's files in
place once all are written.

There are no transactions: a run that ends between two partitions leaves each of them old or new. An update that
leaves changed rows alone when it runs again (such as filling missing values) goes on from there, and changes nothing
after a run that went through. Two updates of one table at a time are not supported.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import delete_folder, shared_folder

# Touched partitions that are written into the filter of the second pass; more are joined.
LISTED = 256

Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Updated:
    """What an update did: changed rows, rows of the partitions written, and their number."""

    changed: int
    rewritten: int
    partitions: int


def _in_partitions(df: DataFrame, keys: Sequence[str], touched: DataFrame, values: list) -> DataFrame:
    """Rows of some partitions; a short list becomes a filter that prunes the folders to read."""
    if len(values) <= LISTED:
        def same(value) -> Column:
            return reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.lit(value[k])) for k in keys])

        return df.filter(reduce(Column.__or__, [same(v) for v in values]))
    other = touched.toDF(*[f"__{k}" for k in keys])
    condition = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys])
    return df.join(F.broadcast(other), condition, "left_semi")  # one row per partition of the table


def update_in_place(
    spark: SparkSession, path: str, change: Change, partition_by: Sequence[str], flag: str = "changed"
) -> Updated:
    """Apply `change` to the table at `path` and rewrite the partitions in which it changed a row.

    `change` gets the table and returns all of its rows and columns and a boolean column `flag`; it must not add or
    drop rows (checked per run), nor change the partitioning columns (a row would stay where it was).
    """
    keys = list(partition_by)
    table = spark.read.parquet(path)
    if not keys or any(k not in table.columns for k in keys):
        raise ValueError("the table must be partitioned by the given columns")
    new = change(table)
    missing = [c for c in [*table.columns, flag] if c not in new.columns]
    if missing:
        raise ValueError(f"the update lacks the columns {missing}")
    # one row per partition of the table reaches the driver
    touched = new.filter(F.col(flag)).select(*[f"`{k}`" for k in keys]).distinct()
    values = touched.collect()
    if not values:
        return Updated(0, 0, 0)
    listed = spark.createDataFrame(values, touched.schema)
    part = _in_partitions(new, keys, listed, values)
    staging = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    seen = Observation()
    casted = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema.fields]
    counted = part.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("changed"))
    # files of a partition come from few tasks; a large partition is cut into several
    counted.select(*casted).hint("rebalance", *keys).write.partitionBy(*keys).parquet(staging)
    before = _in_partitions(table, keys, listed, values).count()
    n, changed = seen.get["n"], seen.get["changed"]
    if n != before:
        delete_folder(spark, staging)
        raise ValueError(f"the update made {n} rows of {before}")
    staged = spark.read.schema(table.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    spark.catalog.refreshByPath(path)
    delete_folder(spark, staging)
    return Updated(changed, n, len(values))
