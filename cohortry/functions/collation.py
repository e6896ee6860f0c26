"""Text that compares as on a server that ignores case and blanks at the end.

Grouping, distinct, joins, comparisons, IN and contains follow the collation of a column; values stay as they are. LIKE
is the exception: patterns see blanks at the end, so `collated_like` matches without the rule for blanks.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equality of texts on such a server, and matching of patterns.
SERVER, SERVER_PATTERNS = "UTF8_LCASE_RTRIM", "UTF8_LCASE"


def under_collation(df: DataFrame, columns: Iterable[str], collation: str = SERVER) -> DataFrame:
    """`df` with some text columns under a collation."""
    return df.withColumns({c: F.collate(F.col(f"`{c}`"), collation) for c in columns})


def plain_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns compare byte by byte again."""
    return under_collation(df, columns, "UTF8_BINARY")


def collated_like(col: Column, patterns: Iterable[str], collation: str = SERVER_PATTERNS) -> Column:
    """Whether a text matches one of some LIKE patterns under a collation."""
    text = F.collate(F.collate(col, "UTF8_BINARY"), collation)
    return reduce(Column.__or__, [text.like(p) for p in patterns])
