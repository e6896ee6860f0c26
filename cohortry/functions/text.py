"""Text expressions. All are native Spark columns, none is a UDF."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    BRACKET_PREFIX, CODE_HEAD_WIDTH, EXCLUDED_CODE_MARKER, PLAIN_BRACKETS, QUESTION_MARKS, WHITE_SPACE, WIDE_BRACKETS,
)


def like(col: Column, pattern: str) -> Column:
    """LIKE in time linear in the text, also for patterns with several parts.

    Spark runs `%a%b%` as a regular expression, which goes back and forth on a long text
    that has many `a` and no `b`. Taking the first place of each part after the part
    before decides the same, so that is what a pattern of plain parts becomes.
    """
    parts = pattern.split("%")
    if "_" in pattern or "\\" in pattern or sum(map(bool, parts)) < 2:
        return col.like(pattern)
    first, *middle, last = parts
    found = col.startswith(first) if first else F.lit(True)
    after = F.lit(len(first) + 1)
    for part in filter(None, middle):
        at = F.position(F.lit(part), col, after)
        found = found & (at > 0)
        after = at + len(part)
    if last:
        found = found & col.endswith(last) & (F.length(col) - len(last) + 1 >= after)
    # a place counted from a missing one is 0, not NULL
    return F.when(col.isNotNull(), found)


def any_like(col: Column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """True where `col` matches at least one LIKE pattern.

    Whether LIKE ignores case is a property of the source system, hence the parameter.
    """
    patterns = list(patterns)
    if not patterns:
        raise ValueError("any_like needs at least one pattern")
    if ignore_case:
        # lower() once instead of ilike per pattern keeps the fast paths
        col, patterns = F.lower(col), [p.lower() for p in patterns]
    return reduce(lambda a, b: a | b, (like(col, p) for p in patterns))


def strip_text(col: Column) -> Column:
    """Remove Unicode white space on both sides; `trim` alone leaves U+3000."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def drop_bracket_prefix(col: Column) -> Column:
    """Remove one leading bracketed remark, ASCII or full-width brackets.

    Lazy up to the first closing bracket, then any closing brackets next to it.
    (?d) limits line ends to a line feed, so a carriage return inside the
    brackets does not stop the match.
    """
    return F.regexp_replace(col, "(?d)" + BRACKET_PREFIX, "")


def ascii_brackets(col: Column) -> Column:
    """Full-width to ASCII parentheses."""
    return F.translate(col, WIDE_BRACKETS, PLAIN_BRACKETS)


def drop_question_marks(col: Column) -> Column:
    """Remove `?` and its full-width form."""
    return F.translate(col, QUESTION_MARKS, "")


def clean_label(col: Column) -> Column:
    """Strip, then remove question marks; blanks inside stay as they are."""
    return drop_question_marks(strip_text(col))


def code_head(col: Column, width: int = CODE_HEAD_WIDTH) -> Column:
    """The first characters of a code after stripping."""
    return F.substring(strip_text(col), 1, width)


def excluded_code(col: Column, marker: str = EXCLUDED_CODE_MARKER, width: int = CODE_HEAD_WIDTH) -> Column:
    """True where the code head contains `marker`."""
    return code_head(col, width).contains(marker)
