"""Key-level set operations and row replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import Hot, as_list, skew_join


def restrict_to(df: DataFrame, members: DataFrame, key: str, spread_by: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is among the members."""
    return skew_join(df, members.select(key), key, "left_semi", spread_by=spread_by)


def exclude(
    df: DataFrame, members: DataFrame, key: str, spread_by: Sequence[str] = (), hot: Hot | None = None
) -> DataFrame:
    """Rows whose key is not among the members; members that are not present do not matter."""
    return skew_join(df, members.select(key).dropna(), key, "left_anti", spread_by=spread_by, hot=hot)


def drop_keys_where(
    df: DataFrame, key: str, bad: Column, spread_by: Sequence[str] = (), hot: Hot | None = None
) -> DataFrame:
    """Remove every row of a key as soon as one of its rows is bad."""
    return exclude(df, df.filter(bad).select(key).distinct(), key, spread_by, hot)


def keys_minus(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of `left` that are not in `right`."""
    # distinct before the join: a hot key is one row by then
    return left.select(key).dropna().distinct().join(right.select(key).dropna().distinct(), key, "left_anti")


def first_per_key(df: DataFrame, keys: str | list[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key: the first (last) in `order`. Map tasks send one row per key."""
    keys = as_list(keys)
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(rest, order).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def combine_first(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "outer",
    hot: Hot | None = None,
) -> DataFrame:
    """Align on a key and fill NULL cells of `left` from `right`, cell by cell.

    A key repeated on both sides multiplies. `how='left'` leaves out keys found on the
    right only. Columns of either side are kept, shared ones are coalesced. `hot` names keys
    known to be hot on either side.
    """
    on = as_list(on)
    if how not in ("outer", "left"):
        raise ValueError("how is 'outer' or 'left'")
    shared = [c for c in right.columns if c in left.columns and c not in on]
    extra = [c for c in right.columns if c not in left.columns]
    other = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    filled = skew_join(left, other, on, "left", hot=hot).select(
        *on,
        *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in shared else F.col(c)
          for c in left.columns if c not in on],
        *extra,
    )
    if how == "left":
        return filled
    only_right = skew_join(right, left.select(*on), on, "left_anti", hot=hot)
    return filled.unionByName(only_right, allowMissingColumns=True).select(*filled.columns)
