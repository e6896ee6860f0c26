"""Label and code expressions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def person_key(col: Column) -> Column:
    """Whole-number person key. NULL stays NULL, malformed text raises in ANSI mode."""
    return col.cast("bigint")


def follow_up_label(gap_days: Column) -> Column:
    """-1 for an end on or before the index day, otherwise 1 (an unknown gap is 1)."""
    return F.when(gap_days < 1, F.lit(-1)).otherwise(F.lit(1))


def encode(col: Column, mapping: Mapping) -> Column:
    """Map a handful of constants to codes; a value outside the mapping becomes NULL."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items())
    return F.create_map(*pairs)[col]


def fill_missing(value: Column, source: Column, marker: str) -> Column:
    """`marker` where the source value is NULL, otherwise `value` unchanged."""
    return F.when(source.isNull(), F.lit(marker)).otherwise(value)
