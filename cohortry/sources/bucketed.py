"""Tables stored in buckets by a key, so that work per key needs no shuffle.

Every bucket is one file, sorted. Grouping by the key, joining tables of the same buckets and restricting by keys read
each bucket where it lies. A key with a large part of the rows would make one bucket and one task large, so the rows of
such keys are stored beside the buckets, as a plain table; work per key runs over both and the results are united.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, hot_rows
from .shared import remember_written, shared_folder, written


@dataclass(frozen=True)
class Bucketed:
    """Some tables by name, each in two parts: in buckets, and the rows of hot keys (None if no key is hot)."""

    key: str
    buckets: int
    cold: Mapping[str, DataFrame]
    hot: Mapping[str, DataFrame] | None

    def per_key(self, work: Callable[[Mapping[str, DataFrame]], DataFrame]) -> DataFrame:
        """The result of `work`, which must treat every key on its own, over all keys."""
        parts = [work(self.cold)] + ([work(self.hot)] if self.hot else [])
        return reduce(DataFrame.unionByName, parts)


def store_bucketed(tables: Mapping[str, DataFrame], key: str, buckets: int, sort_by: Mapping[str, Sequence[str]] | None = None) -> Bucketed:
    """Store tables in the same buckets by `key`, each sorted by the key and `sort_by`.

    Choose the number of buckets so that one fits a task. Keys with more than two mean buckets of some table's rows are hot.
    Rows without the key are stored like others, in one bucket, unless there are many of them.
    """
    hot: dict[int, int] = {}
    for df in tables.values():
        hot |= hot_keys(df, key, tasks=buckets)
    cold, beside = {}, {}
    for name, df in tables.items():
        order = [key, *[c for c in (sort_by or {}).get(name, ()) if c != key]]
        rows = df
        if hot:
            marked = hot_rows(df, key, hot, "__salts")
            beside[name] = written(marked.filter(F.col("__salts").isNotNull()).drop("__salts"), f"hot-{name}")
            rows = marked.filter(F.col("__salts").isNull()).drop("__salts")
        cold[name] = _stored(rows, name, key, buckets, order)
    return Bucketed(key, buckets, cold, beside or None)


def _stored(rows: DataFrame, name: str, key: str, buckets: int, order: Sequence[str]) -> DataFrame:
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    # dealt by the key as buckets are: one task writes one bucket
    dealt = rows.repartition(buckets, F.col(f"`{key}`"))
    dealt.write.bucketBy(buckets, key).sortBy(*order).option("path", path).saveAsTable(table)
    remember_written(spark, path)
    return spark.table(table)
