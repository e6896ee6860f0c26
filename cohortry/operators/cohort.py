"""Cohort assembly: index events, outcomes, exclusions, follow-up end and label."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import EXCLUDED_PATTERNS, INDEX_PATTERNS, OUTCOME_PATTERNS
from ..functions.labels import follow_up_label
from ..functions.text import any_like
from ..functions.time import calendar_days
from ..sources.shared import written
from .events import KIND, EventColumns, Milestones, linked_milestones
from .linking import canonical_person
from .skew import Hot, as_list, hot_keys, skew_join


def as_outcome(df: DataFrame, columns: EventColumns, prefix: str = "outcome") -> DataFrame:
    """Person, time and text of events, named after their role."""
    return df.select(
        columns.person,
        F.col(columns.time).alias(f"{prefix}_time"),
        F.col(columns.text).alias(f"{prefix}_text"),
    )


def build_cohort(
    index: DataFrame,
    outcome: DataFrame,
    excluded: DataFrame,
    contact: DataFrame,
    columns: EventColumns = EventColumns(),
    required: Sequence[str] = (),
) -> DataFrame:
    """One row per index event and end of follow-up.

    * every outcome of the person is attached; ties multiply,
    * persons in `excluded` go,
    * a person with an index row that lacks its time or a `required` column goes whole,
    * without an outcome, follow-up ends at the last contact,
    * the label compares calendar days: 1 if the end lies after the index day, else -1.

    `observed` tells a real outcome (true) from a filled end. The frame keeps both labels;
    the study population is `cohort.filter('label = 1')`.
    """
    c = columns
    index = index.withColumnsRenamed({c.time: "index_time", c.text: "index_text"})
    incomplete = reduce(lambda a, b: a | b, (F.col(n).isNull() for n in ("index_time", *required)))
    gone = excluded.select(c.person).dropna().union(index.filter(incomplete).select(c.person)).distinct()
    kept = index.join(gone, c.person, "left_anti")

    # one end time per person: joins by person meet unique keys
    outcome, contact = as_outcome(outcome, c, "end"), as_outcome(contact, c, "end")
    first = outcome.groupBy(c.person).agg(F.min("end_time").alias("__outcome"))
    last = contact.groupBy(c.person).agg(F.max("end_time").alias("__contact"))
    timed = (
        kept.join(first, c.person, "left").join(last, c.person, "left")
        .withColumn("observed", F.col("__outcome").isNotNull())
        .withColumn("end_time", F.coalesce("__outcome", "__contact"))
        .drop("__outcome", "__contact")
    )
    # then every event at that time, written once: it is read for its hot keys and for the join
    ends = outcome.withColumn("observed", F.lit(True)).unionByName(contact.withColumn("observed", F.lit(False)))
    followed = skew_join(written(ends, "ends"), timed, [c.person, "end_time", "observed"]).select(*timed.columns, "end_text")
    open_end = timed.filter(F.col("end_time").isNull()).withColumn("end_text", F.lit(None).cast("string"))
    return _labelled(followed.unionByName(open_end))


def _labelled(followed: DataFrame) -> DataFrame:
    gap = calendar_days(F.col("index_time"), F.col("end_time"))
    return followed.withColumn("gap_days", gap).withColumn("label", follow_up_label(F.col("gap_days")))


def _columns(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _people(found: Milestones, keep: Sequence[str], required: Sequence[str]) -> DataFrame:
    """One row per person: index events (array, ties kept), time of the first outcome and the last
    contact, and whether the person is excluded or lacks a required column."""
    c, table = found.events.columns, found.table
    kind, time = F.col(KIND), F.col(c.time)
    event = F.struct(time.alias("index_time"), F.col(c.text).alias("index_text"), *_columns(keep))
    rank = F.struct(*_columns([c.time, *c.order]))
    candidate = (kind == "index") & (time.isNotNull() | F.lit(found.events.reduced == "first"))
    firsts = [
        F.min_by(event, F.when(candidate & (F.col(c.source) == s), rank)).alias(f"__s{i}")
        for i, s in enumerate(found.events.sources)
    ]
    people = table.groupBy(c.person).agg(
        *firsts,
        F.bool_or(kind == "excluded").alias("__excluded"),
        F.min(F.when(kind == "outcome", time)).alias("__outcome"),
        F.max(F.when(kind == "contact", time)).alias("__contact"),
    )
    dated = F.filter(
        F.array(*[f"__s{i}" for i in range(len(firsts))]), lambda e: e.isNotNull() & e["index_time"].isNotNull()
    )
    people = people.withColumn("__dated", dated)
    earliest = F.array_min(F.transform("__dated", lambda e: e["index_time"]))
    people = people.withColumn("__first", earliest)
    people = people.withColumn("__index", F.filter("__dated", lambda e: e["index_time"] == F.col("__first")))
    incomplete = F.lit(False)
    if required:
        incomplete = F.exists("__index", lambda e: reduce(lambda a, b: a | b, (e[n].isNull() for n in required)))
    return people.select(
        c.person, "__first", "__index", "__excluded", "__outcome", "__contact", incomplete.alias("__incomplete")
    )


def cohort_of(found: Milestones, required: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """`build_cohort` over milestones of the kinds index, outcome, excluded and contact.

    Same rows, but milestones need no joins to find them: one aggregate per person yields
    the index events, the exclusion and the time of the end. Only the texts at that
    time are joined, equal ones as a count, so that many copies of one text do not travel.
    `keep` names the person columns of the result, by default all columns of the index event.
    """
    c, table = found.events.columns, found.table
    kind, time = F.col(KIND), F.col(c.time)
    if keep is None:
        keep = [n for n in table.columns if n not in (KIND, c.person, c.time, c.text)]
    people = _people(found, keep, required).filter(~F.col("__excluded") & ~F.col("__incomplete"))
    timed = people.select(
        c.person,
        F.explode("__index").alias("e"),
        F.col("__outcome").isNotNull().alias("observed"),
        F.coalesce("__outcome", "__contact").alias("end_time"),
    ).select(c.person, "e.*", "observed", "end_time")

    # contacts are distinct; equal outcomes keep their number, in groups that differ by a hash of
    # the event, so that neither one row nor one task holds all of them
    observed = kind == "outcome"
    part = F.when(observed, F.pmod(F.xxhash64(*_columns(c.order or [c.record])), F.lit(COPY_GROUPS))).otherwise(F.lit(0))
    ending = table.filter(kind.isin("outcome", "contact") & time.isNotNull())
    on = [c.person, "end_time", "observed"]
    # equal outcomes weigh as many rows as they are
    hot = hot_keys(ending.select(c.person, time.alias("end_time"), observed.alias("observed")), on)
    ends = (
        ending.groupBy(
            c.person, time.alias("end_time"), observed.alias("observed"), F.col(c.text).alias("end_text"),
            part.cast("int").alias("__part"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n", F.when(F.col("observed"), F.col("n")).otherwise(F.lit(1)))
    )
    matched = skew_join(ends, timed, on, hot=hot, spread_by=["end_text", "__part"])
    # two steps, so that an array holds the square root of a count
    step = F.ceil(F.sqrt("n"))
    blocks = matched.withColumn("__step", step).withColumn("__at", F.explode(F.expr("sequence(1, n, __step)")))
    followed = blocks.withColumn("__at", F.explode(F.expr("sequence(__at, least(n, __at + __step - 1))"))).drop(
        "n", "__part", "__step", "__at"
    )
    open_end = timed.filter(F.col("end_time").isNull())
    result = _labelled(followed.unionByName(open_end, allowMissingColumns=True))
    return result.select(
        c.person, "index_time", "index_text", *_columns(keep), "end_time", "end_text", "observed", "gap_days", "label"
    )


# Columns of the diagnosis, visit and person tables. Events at one time come in order of their text.
CLINICAL_COLUMNS = EventColumns(
    person="MASTER_INDEX", record="PERSON_ID", time="DIAG_TIME", text="DISEASE_NAME", source="SOURCE",
    order=("DISEASE_NAME", "REG_ID"),
)
# Groups that equal outcomes of one person are counted in.
COPY_GROUPS = 256


def study_cohort(
    diagnoses: Mapping[str, DataFrame] | DataFrame,
    visits: Mapping[str, DataFrame],
    persons: DataFrame,
    *,
    index: Iterable[str] = INDEX_PATTERNS,
    outcome: Iterable[str] = OUTCOME_PATTERNS,
    excluded: Iterable[str] = EXCLUDED_PATTERNS,
    ignore_case: bool = False,
    null_times: str = "first",
    visit: str = "REG_ID",
    real_person: str = "MASTER_INDEX2",
    columns: EventColumns = CLINICAL_COLUMNS,
    required: Sequence[str] = ("BIRTHDAY",),
) -> DataFrame:
    """The labelled cohort from diagnosis and visit tables per source and one person table.

    Diagnoses may also come as one frame with a source column. Each table is read once. The study population is `filter('label = 1')`.
    """
    text = F.col(columns.text)
    kinds = {
        "index": any_like(text, index, ignore_case),
        "outcome": any_like(text, outcome, ignore_case),
        "excluded": any_like(text, excluded, ignore_case),
        "contact": None,
    }
    people = canonical_person(persons, real_person, columns.person)
    found = linked_milestones(diagnoses, visits, people, visit, columns, kinds, ["contact"], null_times)
    return cohort_of(found, required, keep=[n for n in people.columns if n != columns.person])


def attrition_of(found: Milestones, required: Sequence[str] = ()) -> DataFrame:
    """Rows and persons of `cohort_of` after each of its steps, from one row per person.

    The steps are: with an index event, not excluded, complete, and followed beyond the index day
    (with one row per index event and end of follow-up). Ends are counted, not joined.
    """
    c = found.events.columns
    kind, time = F.col(KIND), F.col(c.time)
    texts = found.table.filter(kind.isin("outcome", "contact") & time.isNotNull()).groupBy(
        c.person, time.alias("t"), kind.alias("k"), F.col(c.text).alias("text")
    ).agg(F.count(F.lit(1)).alias("n"))
    # outcomes keep their number, contacts are distinct
    times = texts.groupBy(c.person, "t", "k").agg(
        F.sum(F.when(F.col("k") == "outcome", F.col("n")).otherwise(F.lit(1))).alias("n")
    )
    ends = times.groupBy(c.person).agg(
        F.min_by("n", F.when(F.col("k") == "outcome", F.col("t"))).alias("outcomes"),
        F.max_by("n", F.when(F.col("k") == "contact", F.col("t"))).alias("contacts"),
    )
    people = _people(found, required, required).filter(F.size("__index") > 0).join(ends, c.person, "left")
    end = F.coalesce("__outcome", "__contact")
    followed = follow_up_label(calendar_days(F.col("__first"), end)) == 1
    n_ends = F.when(end.isNull(), F.lit(1)).otherwise(F.coalesce("outcomes", "contacts"))
    allowed, complete = ~F.col("__excluded"), ~F.col("__excluded") & ~F.col("__incomplete")
    rows = F.size("__index").cast("bigint")
    steps = [
        ("index event", F.lit(True), rows), ("not excluded", allowed, rows), ("required columns known", complete, rows),
        ("end after index", complete & followed, rows * n_ends),
    ]
    counts = people.agg(F.array(*[
        F.struct(
            F.lit(i).alias("step_no"), F.lit(name).alias("step"),
            F.coalesce(F.sum(F.when(there, n)), F.lit(0)).cast("bigint").alias("n_rows"), F.count_if(there).alias("n_persons"),
        )
        for i, (name, there, n) in enumerate(steps, 1)
    ]).alias("steps"))
    return counts.select(F.inline("steps"))


def attrition(steps: Mapping[str, DataFrame], person: str) -> DataFrame:
    """Rows and distinct persons after each step, in step order."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(person).alias("n_persons")).select(
            F.lit(i).alias("step_no"), F.lit(name).alias("step"), "n_rows", "n_persons"
        )
        for i, (name, df) in enumerate(steps.items(), 1)
    ]
    return reduce(DataFrame.unionByName, counts)


def left_join_suffixed(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    hot: Hot | None = None,
) -> DataFrame:
    """Left join on a key; columns that both sides have get a suffix each."""
    on = as_list(on)
    both = [c for c in left.columns if c in right.columns and c not in on]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return skew_join(a, b, on, "left", hot=hot)


def events_after_index(
    events: DataFrame,
    cohort: DataFrame,
    person: str,
    time: str,
    index_time: str = "index_time",
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Events strictly after the index time of their person, with that index time.

    Tied cohort rows share one index time, so the cohort is reduced to one row per
    person and every event appears at most once.
    """
    starts = cohort.groupBy(person).agg(F.min(index_time).alias(index_time))
    return skew_join(events, starts, person, spread_by=spread_by).filter(F.col(time) > F.col(index_time))


def frequency(df: DataFrame, value: str | Column, name: str = "value") -> DataFrame:
    """Counts per value, most frequent first; NULL is not counted."""
    column = F.col(value) if isinstance(value, str) else value
    return (
        df.select(column.alias(name)).dropna().groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(name))
    )
