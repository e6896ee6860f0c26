"""Index events, outcomes, exclusions and last contacts over several event sources."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_like
from ..sources.shared import written
from .skew import Hot, as_list, skew_join


@dataclass(frozen=True)
class EventColumns:
    """Which columns play which role.

    `person` is the real person, `record` one of possibly several files of that person.
    `order` breaks ties between rows at the same time and should identify a row, so
    that results do not depend on task order.
    """

    person: str = "person"
    record: str = "record"
    time: str = "time"
    text: str = "text"
    source: str = "source"
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Events:
    """Events of all sources in one frame that has a source column.

    `reduced` says that the frame holds at most one event per record and source already, and
    how events without a time were ranked for that ('first' or 'drop').
    """

    frame: DataFrame
    sources: tuple[str, ...]
    columns: EventColumns = field(default_factory=EventColumns)
    reduced: str | None = None

    @classmethod
    def of(cls, sources: Mapping[str, DataFrame], columns: EventColumns = EventColumns()) -> "Events":
        return cls(union_sources(sources, columns.source), tuple(sources), columns)

    def where(self, condition: Column) -> "Events":
        return replace(self, frame=self.frame.filter(condition))

    def matching(self, patterns: Iterable[str], ignore_case: bool = False) -> "Events":
        return self.where(any_like(F.col(self.columns.text), patterns, ignore_case))


def union_sources(sources: Mapping[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows of all sources, duplicates kept, with the source name as a column."""
    frames = [df.withColumn(source, F.lit(name)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, frames)


def rows_at_extreme(
    df: DataFrame,
    keys: str | Sequence[str],
    time: str,
    how: str = "min",
    hot: Hot | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """All rows at the earliest or latest time of their key, ties kept.

    One value per key is aggregated with a map-side combine and joined back on key and
    time. So a group is never gathered in one task: its rows spread by time, and a
    large group of ties at one time is salted. Rows without a key or time are removed.
    """
    keys = as_list(keys)
    df = df.dropna(subset=[*keys, time])
    extreme = df.groupBy(*keys).agg((F.min if how == "min" else F.max)(time).alias(time))
    # one extreme per key: an inner join keeps each row once
    return skew_join(df, extreme, [*keys, time], hot=hot, spread_by=spread_by).select(*df.columns)


def _null_times(events: Events, wanted: str) -> str:
    """How to rank events without a time; for reduced events that is decided already."""
    if wanted not in ("first", "drop"):
        raise ValueError("null_times is 'first' or 'drop'")
    if events.reduced == "first" and wanted == "drop":
        raise ValueError("events are reduced already: give null_times to milestones")
    return events.reduced or wanted


def _extreme_per_source(events: Events, keys: Sequence[str], how: str, null_times: str) -> DataFrame:
    """One row per value of `keys` with an array: the earliest (latest) event of each source.

    A plain aggregate: every map task sends at most one row per key, however many
    events a key has. A missing time is the lowest value, so it comes first in
    ascending and last in descending order; an earliest event without a time hides the dated
    events of its source. `null_times='drop'` removes such events beforehand.
    """
    c = events.columns
    frame = events.frame.filter(F.col(c.person).isNotNull())
    if null_times == "drop":
        frame = frame.filter(F.col(c.time).isNotNull())
    row = F.struct(*[F.col(f"`{n}`") for n in frame.columns])
    rank = F.struct(*[F.col(f"`{n}`") for n in (c.time, *c.order)])
    pick = F.min_by if how == "min" else F.max_by
    per_source = [
        pick(row, F.when(F.col(c.source) == name, rank)).alias(f"__s{i}") for i, name in enumerate(events.sources)
    ]
    found = frame.groupBy(*[F.col(f"`{k}`").alias(f"__key_{k}") for k in keys]).agg(*per_source)
    dated = F.filter(
        F.array(*[f"__s{i}" for i in range(len(events.sources))]),
        lambda e: e.isNotNull() & e[c.time].isNotNull(),
    )
    return found.select(*[f"`__key_{k}`" for k in keys], dated.alias("__events"))


def first_occurrence(
    events: Events,
    patterns: Iterable[str] | None = None,
    *,
    per: str = "person",
    null_times: str = "first",
    ignore_case: bool = False,
) -> DataFrame:
    """Each person's first matching event over all sources, ties kept.

    `per='person'` takes the earliest event of each person and source, `per='record'`
    that of each record of the person and source; then all rows at the person's earliest time remain.
    """
    c = events.columns
    null_times = _null_times(events, null_times)
    if patterns is not None:
        events = events.matching(patterns, ignore_case)
    columns = events.frame.columns
    if per == "person":
        # at most one event per source and person: the rest happens inside the row
        found = _extreme_per_source(events, [c.person], "min", null_times)
        earliest = F.array_min(F.transform("__events", lambda e: e[c.time]))
        tied = found.withColumn("__first", earliest).withColumn(
            "__events", F.filter("__events", lambda e: e[c.time] == F.col("__first"))
        )
        return _exploded(tied, [c.person], columns)
    if per == "record":
        found = _per_record(events, "min", null_times)
        return rows_at_extreme(found, c.person, c.time, "min", spread_by=_spread(events))
    raise ValueError("per is 'person' or 'record'")


def _exploded(found: DataFrame, keys: Sequence[str], columns: list[str]) -> DataFrame:
    own = [f"`__key_{k}`" for k in keys]
    # the grouping columns themselves keep the partitioning for later joins
    fields = [F.col(f"`__key_{n}`" if n in keys else f"e.`{n}`").alias(n) for n in columns]
    return found.select(*own, F.explode("__events").alias("e")).select(*fields)


def _per_record(events: Events, how: str, null_times: str = "first") -> DataFrame:
    """The earliest (latest) dated event of each record and source, as a written table.

    A record counts once for each person it belongs to. The table is read three times by
    `rows_at_extreme` (times, hot ties, rows), raw events are read once.
    """
    c = events.columns
    if events.reduced:
        return events.frame.dropna(subset=[c.person, c.time])
    keys = list(dict.fromkeys([c.person, c.record]))
    found = _exploded(_extreme_per_source(events, keys, how, null_times), keys, events.frame.columns)
    return written(found, "records")


def _spread(events: Events) -> list[str]:
    return list(events.columns.order)


def latest_per_record(events: Events) -> DataFrame:
    """The latest dated event of each record and source."""
    return _per_record(events, "max")


def last_contact(events: Events, keys: DataFrame | None = None) -> DataFrame:
    """All distinct (person, time, text) at each person's latest contact.

    `keys` limits the result to some persons. The limit applies after events are
    reduced to one row per record and source, so raw events are never shuffled for it.
    """
    c = events.columns
    lean = events.frame.select(*dict.fromkeys([c.person, c.record, c.time, c.text, c.source, *c.order]))
    latest = latest_per_record(replace(events, frame=lean)).select(c.person, c.time, c.text)
    if keys is not None:
        latest = latest.join(keys.select(c.person).distinct(), c.person, "left_semi")
    # distinct first: equal contacts would share a salt
    return rows_at_extreme(latest.distinct(), c.person, c.time, "max", spread_by=[c.text])


# Column of a milestones table.
KIND = "__kind"


def _tagged(frame: DataFrame, kinds: Mapping[str, Column | None]) -> DataFrame:
    """One row per event and kind it belongs to."""
    tags = F.array(*[F.lit(k) if when is None else F.when(when, F.lit(k)) for k, when in kinds.items()])
    return frame.withColumn(KIND, F.explode(F.array_compact(tags)))


def _reduced(tagged: DataFrame, by: Sequence[str], c: EventColumns, latest: list[str], null_times: str) -> DataFrame:
    """The earliest row of each group and kind, or the latest for kinds in `latest`."""
    row = F.struct(*[F.col(f"`{n}`") for n in tagged.columns])
    # an event without a time still names an excluded person, so it is ranked, not removed
    undated = F.lit(null_times == "drop") & F.col(c.time).isNull()
    rank = F.struct(*[F.col(f"`{n}`") for n in (c.time, *c.order)])
    first = F.struct(undated.alias("undated"), rank.alias("rank"))
    # each row counts for one of the two picks only
    is_latest = F.col(KIND).isin(latest)
    pick = F.coalesce(F.min_by(row, F.when(~is_latest, first)), F.max_by(row, F.when(is_latest, rank)))
    return tagged.groupBy(*by, KIND).agg(pick.alias("__row")).select("__row.*")


@dataclass(frozen=True)
class Milestones:
    """A table with one event per record, source and kind; `self[kind]` are the Events of a kind."""

    table: DataFrame
    events: Events

    def __getitem__(self, kind: str) -> Events:
        return replace(self.events, frame=self.table.filter(F.col(KIND) == kind).drop(KIND))


def _written(reduced: DataFrame, sources: Sequence[str], c: EventColumns, null_times: str) -> Milestones:
    table = written(reduced, "milestones", partition_by=[KIND])
    return Milestones(table, Events(table, tuple(sources), c, null_times))


def milestones(
    events: Events,
    kinds: Mapping[str, Column | None],
    latest: Iterable[str] = (),
    null_times: str = "first",
) -> Milestones:
    """Reduce events to the few that a cohort needs, in one scan and one shuffle.

    `kinds` maps a name to the condition of its events (None: every event). Of each person,
    record, source and kind the earliest event stays, or the latest for names in `latest`.
    first_occurrence, last_contact and keys_matching give the same on a part as on all
    events of that kind. `null_times` has the meaning it has in first_occurrence.

    The result is written to the shared folder, partitioned by kind, since it is read
    several times; a lost executor then costs a read of the small table, not a new scan.
    """
    c, null_times = events.columns, _null_times(events, null_times)
    tagged = _tagged(events.frame.dropna(subset=[c.person]), kinds)
    by = list(dict.fromkeys([c.person, c.record, c.source]))
    reduced = _reduced(tagged, by, c, list(latest), null_times)
    return _written(reduced, events.sources, c, null_times)


def linked_milestones(
    events: Mapping[str, DataFrame] | DataFrame,
    visits: Mapping[str, DataFrame],
    persons: DataFrame,
    visit: str,
    columns: EventColumns,
    kinds: Mapping[str, Column | None],
    latest: Iterable[str] = (),
    null_times: str = "first",
) -> Milestones:
    """`milestones` for events that know their visit only: event -> visit -> record -> person.

    Events come as one frame per source or as one frame with a source column.

    Events shrink to one row per visit and kind before they meet the visits, and to one per
    record, source and kind before they meet the persons. So neither join has a hot key
    and raw events are shuffled by the map-side result of an aggregate only.
    """
    c, latest = columns, list(latest)
    frame = union_sources(events, c.source) if isinstance(events, Mapping) else events
    union = Events(frame, tuple(visits), c)
    null_times = _null_times(union, null_times)
    per_visit = _reduced(_tagged(union.frame, kinds), [c.source, visit], c, latest, null_times)
    of_visit = union_sources({n: df.select(visit, c.record) for n, df in visits.items()}, c.source)
    per_record = _reduced(per_visit.join(of_visit, [c.source, visit]), [c.record, c.source], c, latest, null_times)
    linked = per_record.join(persons, c.record).dropna(subset=[c.person])
    return _written(linked, union.sources, c, null_times)


def keys_matching(events: Events, patterns: Iterable[str], ignore_case: bool = False) -> DataFrame:
    """The distinct persons with at least one matching event in any source."""
    c = events.columns
    return events.matching(patterns, ignore_case).frame.select(c.person).dropna().distinct()
