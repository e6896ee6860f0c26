"""Linking events to persons through visits: event -> visit -> person record.

Tables may come per source, as mappings from a source to its table: events then meet visits of
their own source only, and the source becomes a column. A visit may have several key columns.

`link_events` keeps every event. Where only the earliest or latest event, or only the
keys, are needed, `link_extreme` and `link_keys` reduce before each join, so the joins
meet one row per visit or record and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import person_key
from .events import union_sources
from .skew import as_list, skew_join

Table = DataFrame | Mapping[str, DataFrame]
SOURCE = "source"


def canonical_person(persons: DataFrame, real: str = "MASTER_INDEX2", name: str = "MASTER_INDEX") -> DataFrame:
    """Use the real person as the key: the old `name` column goes and `real` takes its name."""
    return persons.drop(name).withColumnRenamed(real, name).withColumn(name, person_key(F.col(name)))


def by_source(visit: str | Sequence[str], *tables: Table) -> tuple[list[str], list[DataFrame]]:
    """The key of a visit, and the tables as frames: with a source column if they come per source."""
    keys = as_list(visit)
    per_source = [isinstance(t, Mapping) for t in tables]
    if not any(per_source):
        return keys, list(tables)
    if not all(per_source):
        raise ValueError("give all tables per source, or none")
    return [SOURCE, *keys], [union_sources(t, SOURCE) for t in tables]


def visit_persons(visits: Table, persons: DataFrame, visit: str | Sequence[str], record: str) -> DataFrame:
    """One row per visit with all columns of its person record; with the source if visits come per source."""
    keys, (visits,) = by_source(visit, visits)
    return skew_join(visits.select(*keys, record), persons, record, spread_by=keys)


def link_events(
    events: Table,
    visits: Table,
    persons: DataFrame,
    visit: str | Sequence[str],
    record: str,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Every event with the columns of its person record."""
    keys, (events, visits) = by_source(visit, events, visits)
    return skew_join(events, visit_persons(visits, persons, keys, record), keys, spread_by=spread_by)


def link_extreme(
    events: Table,
    visits: Table,
    persons: DataFrame,
    visit: str | Sequence[str],
    record: str,
    time: str,
    order: Sequence[str] = (),
    how: str = "min",
) -> DataFrame:
    """The earliest (latest) event of each person record with the columns of the record.

    The extreme of a record is the extreme of its visits' extremes, so events shrink to
    one row per visit before the first join and to one row per record before the second.
    """
    keys, (events, visits) = by_source(visit, events, visits)
    pick = F.min_by if how == "min" else F.max_by
    rank = F.struct(time, *order)
    event = F.struct(*events.columns)
    per_visit = events.groupBy(*keys).agg(pick(event, rank).alias("e"))
    inner_rank = F.struct(*[F.col(f"e.{n}") for n in (time, *order)])
    per_record = (
        per_visit.join(visits.select(*keys, record), keys).groupBy(record).agg(pick(F.col("e"), inner_rank).alias("e"))
    )
    return per_record.join(persons, record).select(record, "e.*", *[c for c in persons.columns if c != record])


def link_keys(
    events: Table, visits: Table, persons: DataFrame, visit: str | Sequence[str], record: str, person: str
) -> DataFrame:
    """The distinct persons behind some events."""
    keys, (events, visits) = by_source(visit, events, visits)
    seen = events.select(*keys).distinct()
    records = visits.select(*keys, record).join(seen, keys, "left_semi").select(record).distinct()
    return persons.select(record, person).join(records, record, "left_semi").select(person).dropna().distinct()
