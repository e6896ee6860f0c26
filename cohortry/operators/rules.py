"""Filling missing codes by name patterns, first matching rule wins.

Rules are looked for in two ways with equal results: by an automaton that reads every name once
(`fill_by_automaton`, no shuffle as long as the rules fit), or by joining pieces of names with patterns
(`fill_by_pattern`, no Python).
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .skew import BroadcastLimit, lookup_join, measured, skew_join
from .trie import NO_RULE, PatternTrie

# Rules of one automaton, which a driver builds and every Python worker holds: at most 16 bytes a
# character of a pattern, and the rules' values. More rules are cut into several automata.
AUTOMATON_LIMIT = BroadcastLimit(rows=200_000, bytes=16 * 1024 * 1024)


def _usable(rules: DataFrame, pattern: str, order: str, values: list[str]) -> DataFrame:
    """(__piece, __rule): for each pattern its first rule."""
    return rules.dropna(subset=[pattern]).groupBy(F.col(pattern).alias("__piece")).agg(
        F.min_by(F.struct(F.col(order).alias("__ord"), *values), F.struct(order)).alias("__rule")
    )


def _automaton(name: Column, usable: DataFrame) -> Column:
    """The first rule whose pattern is in the name, NULL if there is none. `usable` is of a checked size."""
    rows = usable.orderBy("__rule.__ord", "__piece").toArrow()
    patterns = PatternTrie.of(rows.column("__piece").combine_chunks())
    shared = usable.sparkSession.sparkContext.broadcast((patterns, rows.select(["__rule"]).combine_chunks()))

    @F.arrow_udf(usable.schema["__rule"].dataType)
    def first_rule(names: pa.Array) -> pa.Array:
        known, found = shared.value
        distinct = names.dictionary_encode()
        rank = known.first_ranks(distinct.dictionary)
        rank = pa.array(rank, mask=rank == NO_RULE).take(distinct.indices)
        return found.column("__rule").combine_chunks().take(rank)

    return first_rule(name)


def first_rule_per_name(
    names: DataFrame,
    rules: DataFrame,
    *,
    name: str,
    pattern: str,
    order: str,
    values: list[str],
    limit: BroadcastLimit = BroadcastLimit(),
) -> DataFrame:
    """For each distinct name the values of the first rule whose pattern occurs in it.

    "Contains" becomes an equi-join: a name is cut into all its pieces of the lengths that
    patterns have, and a piece equals a pattern or not. So no name meets a rule it does not
    contain, and no pair of all names and all rules is formed. Patterns are literal text.
    """
    usable = _usable(rules, pattern, order, values)
    # at most one row per length, and lengths are bounded by the longest pattern
    lengths = [r[0] for r in usable.select(F.length("__piece").alias("n")).distinct().collect()]
    if not lengths:
        return names.select(name, *[F.lit(None).cast(rules.schema[v].dataType).alias(v) for v in values]).limit(0)
    size = F.array(*[F.lit(n) for n in sorted(lengths)])
    starts = F.when(F.col("__n") == 0, F.array(F.lit(1))).otherwise(
        F.sequence(F.lit(1), F.length(name) - F.col("__n") + 1)
    )
    pieces = (
        names.select(name, F.explode(size).alias("__n"))
        .filter(F.col("__n") <= F.length(name))
        .select(name, "__n", F.explode(starts).alias("__at"))
        .select(name, F.substr(F.col(name), F.col("__at"), F.col("__n")).alias("__piece"))
    )
    hits = lookup_join(pieces, usable, "__piece", "inner", limit)
    first = hits.groupBy(name).agg(F.min_by("__rule", F.col("__rule.__ord")).alias("__rule"))
    return first.select(name, *[F.col(f"__rule.{v}").alias(v) for v in values])


def fill_by_pattern(
    catalog: DataFrame,
    rules: DataFrame,
    *,
    name: str,
    code: str,
    standard: str | None = None,
    rule_pattern: str,
    rule_code: str,
    rule_standard: str | None = None,
    order: str,
    limit: BroadcastLimit = BroadcastLimit(),
) -> DataFrame:
    """Set missing codes from the first rule, in rule order, whose pattern is in the name.

    Rows that have a code stay untouched, and so do rows without a match. Rules without a code
    do not take part. `changed` marks the rows that received a code.
    """
    given, values = _given(rules, rule_pattern, rule_code, rule_standard, order)
    open_names = catalog.filter(F.col(code).isNull()).select(name).dropna().distinct()
    found = first_rule_per_name(
        open_names, given, name=name, pattern="__pattern", order="__order", values=values, limit=limit
    )
    joined = skew_join(catalog, found, name, "left")
    return _filled(joined, catalog.columns, code, standard if rule_standard else None)


def _given(rules: DataFrame, pattern: str, code: str, standard: str | None, order: str) -> tuple[DataFrame, list[str]]:
    """Rules that take part, under fixed names, and which of their columns are values."""
    values = {"__code": code, **({"__std": standard} if standard else {})}
    given = rules.select(
        F.col(pattern).alias("__pattern"), F.col(order).alias("__order"), *[F.col(v).alias(k) for k, v in values.items()],
    ).dropna(subset=["__code", "__pattern"])
    return given, list(values)


def _filled(joined: DataFrame, columns: list[str], code: str, standard: str | None) -> DataFrame:
    """`columns` with the values of the found rule where a code was missing, and `changed`."""
    changed = F.col(code).isNull() & F.col("__code").isNotNull()
    new = {code: F.coalesce(F.col(code), F.col("__code"))}
    if standard:
        new[standard] = F.when(changed, F.col("__std")).otherwise(F.col(standard))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns], changed.alias("changed"))


def fill_by_automaton(
    catalog: DataFrame,
    rules: DataFrame,
    *,
    name: str,
    code: str,
    standard: str | None = None,
    rule_pattern: str,
    rule_code: str,
    rule_standard: str | None = None,
    order: str,
    limit: BroadcastLimit = AUTOMATON_LIMIT,
) -> DataFrame:
    """The same as `fill_by_pattern`, by reading every name once for all patterns together.

    Rules within `limit` make one automaton, and the catalog is not shuffled at all. More rules are cut
    into several by a hash of their patterns; each reads the distinct names that lack a code, and the first
    rule over all of them counts.
    """
    given, values = _given(rules, rule_pattern, rule_code, rule_standard, order)
    usable = written(_usable(given, "__pattern", "__order", values), "rules")
    n, size = measured(usable)
    parts = max(1, -(-n // max(1, limit.rows)), -(-size // max(1, limit.bytes)))
    if parts == 1:
        open_name = F.when(F.col(code).isNull(), F.col(name))
        joined = catalog.withColumn("__rule", _automaton(open_name, usable))
    else:
        names = written(catalog.filter(F.col(code).isNull()).select(name).dropna().distinct(), "open-names")
        shard = F.pmod(F.xxhash64("__piece"), F.lit(parts))
        hits = [names.withColumn("__rule", _automaton(F.col(name), usable.filter(shard == k))) for k in range(parts)]
        first = reduce(DataFrame.union, hits).filter("__rule IS NOT NULL").groupBy(name).agg(
            F.min_by("__rule", F.col("__rule.__ord")).alias("__rule")
        )
        joined = skew_join(catalog, first, name, "left")
    joined = joined.select(*[f"`{c}`" for c in catalog.columns], *[F.col(f"__rule.{v}").alias(v) for v in values])
    return _filled(joined, catalog.columns, code, standard if rule_standard else None)


def rules_of_names(
    standardised: DataFrame, *, name: str, standard: str = "standard", code: str = "code", order: str | None = None
) -> DataFrame:
    """Rules (pattern, rule_code, rule_standard, ord) from standardised names.

    Names without a code make no rule; the name itself is the pattern. Rules come in the order of
    `order`, by default of the names. Names of one order keep the order of their spelling.
    """
    rank = F.struct(F.col(order).alias("at"), F.col(name).alias("name")) if order else F.col(name)
    return standardised.dropna(subset=[name, code]).select(
        F.col(name).alias("pattern"), F.col(code).alias("rule_code"), F.col(standard).alias("rule_standard"), rank.alias("ord")
    ).distinct()


def fill_from_names(
    catalog: DataFrame, standardised: DataFrame, *, name: str, code: str, standard: str, item: str, order: str | None = None,
    limit: BroadcastLimit = AUTOMATON_LIMIT,
) -> DataFrame:
    """Fill codes of `catalog` from standardised names (`item`, standard, code) that its names contain."""
    return fill_by_automaton(
        catalog, rules_of_names(standardised, name=item, order=order), name=name, code=code, standard=standard,
        rule_pattern="pattern", rule_code="rule_code", rule_standard="rule_standard", order="ord", limit=limit,
    )


def changed_rows(df: DataFrame, flag: str = "changed") -> DataFrame:
    """How many rows an update changed."""
    return df.agg(F.count_if(F.col(flag)).alias("n_changed"))
