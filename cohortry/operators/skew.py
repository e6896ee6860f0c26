"""Joins that stay balanced when one key holds a large share of the rows.

* `lookup_join`: the right side is a reference table. Its size is measured; if it
  fits, it is broadcast and the left side is not shuffled at all. If not, the
  join goes through `skew_join`.
* `skew_join`: the right side grows with the data. A frequent-items sketch over
  the left keys (one pass over the key columns, no shuffle by key) names the hot
  keys: those that alone would be a multiple of the mean shuffle task. Only their rows are
  salted on the left and copied on the right, each key by its share; all other
  keys, and every join without hot keys, keep the plain shuffle join.

No row is dropped, capped or sampled: a key the sketch misses is joined like any
other key, and adaptive execution can still split its partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot if it holds more than this many mean shuffle tasks of rows. It is cut into that many
# pieces per mean task, since pieces fall into tasks at random.
HOT_TASKS, PIECES = 2, 8
# What a sketch may report to the driver. With T tasks at most T / HOT_TASKS keys are hot, so
# the bound matters from about 16,000 shuffle partitions on; adaptive execution splits what is left.
MOST_HOT = 8192

# Salts of each hot key by its hash.
Hot = Mapping[int, int]

_HASH, _SALT, _SALTS = "__key_hash", "__salt", "__salts"


@dataclass(frozen=True)
class BroadcastLimit:
    """Largest table that may be broadcast or collected as a lookup."""

    rows: int = 500_000
    bytes: int = 64 * 1024 * 1024


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of `df` (one small job).

    Text, binary and nested columns are measured by their JSON or byte length;
    every value is charged a fixed overhead on top.
    """
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, T.StringType)
         else F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
         if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.lit(0)) + F.lit(16)
        for f in df.schema.fields
    )
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n, size


def fits(df: DataFrame, limit: BroadcastLimit = BroadcastLimit()) -> bool:
    """Measure `df` and compare it with `limit`."""
    n, size = measured(df)
    return n <= limit.rows and size <= limit.bytes


def _key_hash(df: DataFrame, on: list[str]) -> Column:
    """One long per key, equal on both sides of a join.

    Whole numbers hash by width, so they are widened first.
    """
    parts = []
    for name in on:
        kind = df.schema[name].dataType
        col = F.col(f"`{name}`")
        parts.append(col.cast("bigint") if isinstance(kind, T.IntegralType) else col)
    return F.xxhash64(*parts)


def _hashable(left: DataFrame, right: DataFrame, on: list[str]) -> bool:
    """Keys whose equality in a join and in the hash agree."""
    def kind(df: DataFrame, name: str):
        t = df.schema[name].dataType
        return "whole" if isinstance(t, T.IntegralType) else t
    def collated(t) -> bool:  # equal texts may differ in their bytes
        return isinstance(t, T.StringType) and t != T.StringType() or isinstance(t, (T.StructType, T.ArrayType)) and "collate" in t.simpleString()

    kinds = [(kind(left, c), kind(right, c)) for c in on]
    return all(a == b and not isinstance(a, (T.FractionalType, T.MapType)) and not collated(a) for a, b in kinds)


def _tasks(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_profile(df: DataFrame, on: str | Sequence[str], tasks: int | None = None) -> tuple[int, dict[int, int]]:
    """Number of rows, and the hot keys (by hash) with the number of salts that each needs.

    One job that reads the key columns only. `approx_top_k` merges small sketches, so there
    is no shuffle by key, and its estimate is never below the true count. The sketch tracks many
    more items than it reports, which keeps its error well below the share that makes a key hot.
    """
    on = as_list(on)
    tasks = tasks or _tasks(df)
    most = min(MOST_HOT, max(16, -(-tasks // HOT_TASKS)))
    n, top = (
        df.select(_key_hash(df, on).alias(_HASH))
        .agg(F.count(F.lit(1)), F.expr(f"approx_top_k({_HASH}, {most}, {32 * most})"))
        .first()
    )
    return n, {t[0]: -(-PIECES * t[1] * tasks // n) for t in top or [] if t[1] > 1 and t[1] * tasks > HOT_TASKS * n}


def hot_keys(df: DataFrame, on: str | Sequence[str], tasks: int | None = None) -> dict[int, int]:
    """Hashes of the hot keys with their salts, at most MOST_HOT of them."""
    return key_profile(df, on, tasks)[1]


def _salts(df: DataFrame, on: list[str], hot: Hot) -> DataFrame:
    """`df` with the number of salts of its key, or NULL. The table of hot keys is bounded by MOST_HOT rows."""
    table = df.sparkSession.createDataFrame(list(hot.items()), f"{_HASH} bigint, {_SALTS} int")
    return df.withColumn(_HASH, _key_hash(df, on)).join(F.broadcast(table), _HASH, "left").drop(_HASH)


def hot_rows(df: DataFrame, on: str | Sequence[str], hot: Hot, salts: str) -> DataFrame:
    """`df` with the number of salts of its key in a column, NULL for keys that are not hot."""
    return _salts(df, as_list(on), hot).withColumnRenamed(_SALTS, salts)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    *,
    hot: Hot | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Equi-join on equally named columns; hot keys of `left` are spread over many tasks.

    `how` is one of inner, left, left_semi and left_anti. `left` is read once more for its hot
    keys, so it should be a table or close to one; pass `hot` if they are known.

    The salt of a left row comes from its input partition and from `spread_by` columns, by
    default all columns. It does not depend on row order, so a task that runs again after a
    lost executor gives the same salt. Rows that are equal in these columns and lie in one input
    partition share their salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot spread a {how} join")
    on = as_list(on)
    if how in ("left_semi", "left_anti"):
        right = right.select(*on)
    if not _hashable(left, right, on):
        return left.join(right, on, how)
    if hot is None:
        hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    if how in ("left_semi", "left_anti"):
        right = right.distinct()

    by = list(spread_by) or [f.name for f in left.schema.fields if not isinstance(f.dataType, T.MapType)]
    spread = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in by])
    salted = _salts(left, on, hot).withColumn(
        _SALT, F.when(F.col(_SALTS).isNotNull(), F.pmod(spread, _SALTS)).otherwise(F.lit(0)).cast("int")
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    copied = _salts(right, on, hot).withColumn(_SALT, F.explode(copies))
    return salted.drop(_SALTS).join(copied.drop(_SALTS), [*on, _SALT], how).drop(_SALT)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    limit: BroadcastLimit = BroadcastLimit(),
) -> DataFrame:
    """Join a reference table: broadcast if its measured size allows, else `skew_join`."""
    on = as_list(on)
    if fits(lookup, limit):
        return left.join(F.broadcast(lookup), on, how)
    return skew_join(left, lookup, on, how)
