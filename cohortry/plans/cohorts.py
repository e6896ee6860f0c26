"""Queries that define, fill and report cohorts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.labels import follow_up_label, person_key
from ..functions.text import any_like
from ..functions.time import calendar_date, calendar_date_of_text, calendar_days, elapsed_days
from ..operators.asof import as_of, events_within
from ..operators.cohort import (
    as_outcome, attrition, attrition_of, build_cohort, cohort_of, events_after_index, frequency, left_join_suffixed, study_cohort,
)
from ..operators.events import first_occurrence, keys_matching, last_contact, rows_at_extreme, union_sources
from ..operators.linking import canonical_person, link_events, link_extreme, link_keys
from ..operators.sets import combine_first, drop_keys_where, exclude, keys_minus, restrict_to
from ..operators.steps import Steps
from ..sources.bucketed import Bucketed, store_bucketed
from . import fixtures as fx
from .registry import Tables, query

_EVENT = "master, person, source, eid, txt, ts, birthday"
_EVENT_COLUMNS = _EVENT.split(", ")


def cohort(t: Tables):
    """Index events with end of follow-up and label; events are scanned once."""
    return cohort_of(fx.cohort_milestones(t), ["birthday"], keep=["birthday"])


@query("cohort_shared_records", f"WITH {fx.SHARED_COHORT_SQL} SELECT * FROM cohort")
def cohort_shared_records(t):
    """The cohort where a record can hold several persons."""
    return cohort_of(fx.cohort_milestones(t, shared_records=True), ["birthday"], keep=["birthday"])


@query(
    "excluded_shared_records",
    f"""WITH {fx.SHARED_COHORT_SQL} SELECT source, count(DISTINCT master) AS n FROM v
    WHERE txt LIKE '%signup%: 33%' GROUP BY source""",
)
def excluded_shared_records(t):
    found = fx.cohort_milestones(t, shared_records=True)["excluded"].frame
    return found.groupBy("source").agg(F.count_distinct("master").alias("n"))


def _index(t: Tables):
    return first_occurrence(fx.events(t), fx.INDEX)


def _outcome(t: Tables):
    return first_occurrence(fx.events(t), fx.OUTCOME, per="record")


query("cohort", f"WITH {fx.COHORT_SQL} SELECT * FROM cohort")(cohort)


@query("cohort_of_frames", f"WITH {fx.COHORT_SQL} SELECT * FROM cohort")
def cohort_of_frames(t):
    """The same cohort from frames that were found one by one."""
    index = _index(t).select("master", "ts", "txt", "birthday")
    contact = last_contact(fx.events(t), index)
    return build_cohort(
        index, _outcome(t), keys_matching(fx.events(t), fx.EXCLUDED), contact, fx.COLUMNS, ["birthday"]
    )


@query("cohort_members", f"WITH {fx.COHORT_SQL} SELECT * FROM cohort WHERE label = 1")
def cohort_members(t):
    return cohort(t).filter("label = 1")


@query(
    "cohort_label_counts",
    f"WITH {fx.COHORT_SQL} SELECT observed, label, count(*) AS n FROM cohort GROUP BY observed, label",
)
def cohort_label_counts(t):
    return cohort(t).groupBy("observed", "label").agg(F.count(F.lit(1)).alias("n"))


@query("first_occurrence", f"WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL} SELECT {_EVENT} FROM idx")
def first_index(t):
    return _index(t).select(*_EVENT_COLUMNS)


@query(
    "first_occurrence_dated",
    f"""WITH {fx.EVENTS_SQL}, firsts AS (
      SELECT *, row_number() OVER (PARTITION BY source, master ORDER BY ts, eid) AS rn
      FROM v WHERE txt LIKE '%sign%up%' AND ts IS NOT NULL),
    ranked AS (SELECT *, rank() OVER (PARTITION BY master ORDER BY ts) AS rk FROM firsts WHERE rn = 1)
    SELECT {_EVENT} FROM ranked WHERE rk = 1""",
)
def first_dated(t):
    return first_occurrence(fx.events(t), fx.INDEX, null_times="drop").select(*_EVENT_COLUMNS)


@query(
    "first_occurrence_any_case",
    f"""WITH {fx.EVENTS_SQL}, firsts AS (
      SELECT *, row_number() OVER (PARTITION BY source, master ORDER BY ts ASC NULLS FIRST, eid) AS rn
      FROM v WHERE txt ILIKE '%SIGN%up%' OR txt ILIKE '%ERROR%'),
    ranked AS (SELECT *, rank() OVER (PARTITION BY master ORDER BY ts) AS rk FROM firsts WHERE rn = 1 AND ts IS NOT NULL)
    SELECT {_EVENT} FROM ranked WHERE rk = 1""",
)
def first_any_case(t):
    return first_occurrence(fx.events(t), ["%SIGN%up%", "%ERROR%"], ignore_case=True).select(*_EVENT_COLUMNS)


@query("outcome_first", f"WITH {fx.EVENTS_SQL}, {fx.OUTCOME_SQL} SELECT {_EVENT} FROM outc")
def outcome_first(t):
    return _outcome(t).select(*_EVENT_COLUMNS)


@query(
    "first_occurrence_ties",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (
      SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk FROM orders) WHERE rk = 1""",
)
def first_ties(t):
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rows_at_extreme(rows, "o_custkey", "o_orderdate", "min")


@query(
    "last_occurrence_ties",
    """SELECT l_suppkey, l_shipdate, l_orderkey, l_partkey, l_linenumber FROM (
      SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) AS rk FROM lineitem) WHERE rk = 1""",
)
def last_ties(t):
    rows = t.lineitem.select("l_suppkey", "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber")
    return rows_at_extreme(rows, "l_suppkey", "l_shipdate", "max")


@query("exclusion_keys", f"WITH {fx.EVENTS_SQL}, {fx.EXCLUDED_SQL} SELECT master FROM ex")
def exclusion_keys(t):
    return keys_matching(fx.events(t), fx.EXCLUDED)


@query("last_contact", f"WITH {fx.EVENTS_SQL}, {fx.CONTACT_SQL} SELECT * FROM lc")
def last_contacts(t):
    return last_contact(fx.events(t))


@query(
    "last_contact_without_outcome",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}, {fx.OUTCOME_SQL}, {fx.CONTACT_SQL}
    SELECT * FROM lc WHERE master IN (SELECT master FROM idx) AND master NOT IN (SELECT master FROM outc)""",
)
def open_contacts(t):
    return last_contact(fx.events(t), keys_minus(_index(t), _outcome(t), "master"))


@query(
    "index_with_outcome",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}, {fx.OUTCOME_SQL}
    SELECT i.master, i.ts AS ts_x, i.txt AS txt_x, i.eid, i.birthday, o.ts AS ts_y, o.txt AS txt_y
    FROM idx i LEFT JOIN outc o ON i.master = o.master""",
)
def index_with_outcome(t):
    index = _index(t).select("master", "ts", "txt", "eid", "birthday")
    return left_join_suffixed(index, _outcome(t).select("master", "ts", "txt"), "master")


@query(
    "attrition",
    f"""WITH {fx.COHORT_SQL}
    SELECT 1 AS step_no, 'index event' AS step, count(*) AS n_rows, count(DISTINCT master) AS n_persons FROM idx
    UNION ALL SELECT 2, 'not excluded', count(*), count(DISTINCT master) FROM idx
      WHERE master NOT IN (SELECT master FROM ex)
    UNION ALL SELECT 3, 'required columns known', count(*), count(DISTINCT master) FROM idx
      WHERE master NOT IN (SELECT master FROM ex) AND master NOT IN (SELECT master FROM idx WHERE birthday IS NULL)
    UNION ALL SELECT 4, 'end after index', count(*), count(DISTINCT master) FROM cohort WHERE label = 1""",
)
def cohort_attrition(t):
    return attrition_of(fx.cohort_milestones(t), ["birthday"])


@query(
    "step_report",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}, {fx.OUTCOME_SQL}
    SELECT 1 AS step_no, 'index' AS step, count(*) AS n_rows, count(DISTINCT master) AS n_persons FROM idx
    UNION ALL SELECT 2, 'outcome', count(*), count(DISTINCT master) FROM outc""",
)
def step_report(t):
    """Sizes of frames that were found one by one."""
    return attrition({"index": _index(t), "outcome": _outcome(t)}, "master")


_STEPS = f"""{fx.EVENTS_SQL},
    s2 AS (SELECT * FROM v WHERE txt LIKE '%sign%up%'),
    s3 AS (SELECT * FROM s2 WHERE ts IS NOT NULL),
    s4 AS (SELECT * FROM s3 WHERE master NOT IN (SELECT master FROM v WHERE txt LIKE '%signup%: 33%')),
    s5 AS (SELECT * FROM s4 WHERE master NOT IN (SELECT master FROM s4 WHERE birthday IS NULL)),
    s6 AS (SELECT * FROM s5 WHERE master IN (SELECT master FROM v WHERE txt LIKE '%err%: 91%' OR txt LIKE '%purch%: 5%1%'))"""


def _steps(t: Tables) -> Steps:
    found = fx.events(t)
    return (
        Steps(found.frame, "master", "events").keep("index text", any_like(F.col("txt"), fx.INDEX))
        .keep("dated", F.col("ts").isNotNull()).without_keys("not excluded", keys_matching(found, fx.EXCLUDED), ["eid"])
        .drop_keys_where("birthday known", F.col("birthday").isNull(), ["eid"])
        .with_keys("outcome ever", keys_matching(found, fx.OUTCOME), ["eid"])
    )


@query(
    "step_counts",
    f"WITH {_STEPS} " + " UNION ALL ".join(
        f"SELECT {i} AS step_no, '{name}' AS step, count(*) AS n_rows, count(DISTINCT master) AS n_persons FROM {table}"
        for i, (name, table) in enumerate(
            [("events", "v"), ("index text", "s2"), ("dated", "s3"), ("not excluded", "s4"), ("birthday known", "s5"), ("outcome ever", "s6")], 1)
    ),
)
def step_counts(t):
    """Counts after every step of a chain that runs once."""
    return _steps(t).done()[1]


@query("step_rows", f"WITH {_STEPS} SELECT eid, master, txt, ts FROM s6")
def step_rows(t):
    return _steps(t).done()[0].select("eid", "master", "txt", "ts")


@query(
    "index_without_outcome",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}, {fx.OUTCOME_SQL}
    SELECT DISTINCT master FROM idx WHERE master NOT IN (SELECT master FROM outc)""",
)
def index_without_outcome(t):
    return keys_minus(_index(t), _outcome(t), "master")


@query(
    "outcome_without_index",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}, {fx.OUTCOME_SQL}
    SELECT DISTINCT master FROM outc WHERE master NOT IN (SELECT master FROM idx)""",
)
def outcome_without_index(t):
    return keys_minus(_outcome(t), _index(t), "master")


@query(
    "key_level_drop",
    f"""WITH {fx.EVENTS_SQL} SELECT master, eid, ts, birthday FROM v
    WHERE master NOT IN (SELECT master FROM v WHERE birthday IS NULL)""",
)
def key_level_drop(t):
    rows = fx.events(t).frame.select("master", "eid", "ts", "birthday")
    return drop_keys_where(rows, "master", F.col("birthday").isNull())


@query(
    "combine_first",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}, {fx.OUTCOME_SQL}, {fx.CONTACT_SQL},
    a AS (SELECT i.master, i.eid, o.ts, o.txt FROM idx i LEFT JOIN outc o ON i.master = o.master)
    SELECT coalesce(a.master, lc.master) AS master, a.eid, coalesce(a.ts, lc.ts) AS ts, coalesce(a.txt, lc.txt) AS txt
    FROM a FULL JOIN lc ON a.master = lc.master""",
)
def combine_first_query(t):
    index = _index(t).select("master", "eid")
    left = index.join(_outcome(t).select("master", "ts", "txt"), "master", "left")
    return combine_first(left, last_contact(fx.events(t)), "master")


@query(
    "semi_members",
    f"""WITH {fx.COHORT_SQL} SELECT master, eid, ts, txt FROM v
    WHERE master IN (SELECT master FROM cohort WHERE label = 1)""",
)
def semi_members(t):
    rows = fx.events(t).frame.select("master", "eid", "ts", "txt")
    return restrict_to(rows, cohort(t).filter("label = 1"), "master", spread_by=["eid"])


@query(
    "anti_members",
    f"""WITH {fx.EVENTS_SQL}, {fx.EXCLUDED_SQL} SELECT master, eid, ts, txt FROM v
    WHERE master NOT IN (SELECT master FROM ex)""",
)
def anti_members(t):
    rows = fx.events(t).frame.select("master", "eid", "ts", "txt")
    return exclude(rows, keys_matching(fx.events(t), fx.EXCLUDED), "master", spread_by=["eid"])


@query(
    "events_after_index",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}
    SELECT v.master, v.eid, v.txt, v.ts, i.index_time FROM v
    JOIN (SELECT master, min(ts) AS index_time FROM idx GROUP BY master) i ON v.master = i.master
    WHERE v.ts > i.index_time""",
)
def after_index(t):
    starts = as_outcome(_index(t), fx.COLUMNS, "index")
    rows = fx.events(t).frame.select("master", "eid", "txt", "ts")
    return events_after_index(rows, starts, "master", "ts", spread_by=["eid"])


def _in_buckets(t: Tables, buckets: int = 8) -> Bucketed:
    events = fx.events(t)
    return store_bucketed({"events": events.frame, "index": _index(t).select("master", "ts")}, "master", buckets, {"events": ["ts"]})


@query("bucketed_first_occurrence", f"WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL} SELECT {_EVENT} FROM idx")
def bucketed_first_occurrence(t):
    """First events from a table in buckets by person: no shuffle."""
    found = fx.events(t)
    return _in_buckets(t).per_key(
        lambda tables: first_occurrence(replace(found, frame=tables["events"]), fx.INDEX).select(*_EVENT_COLUMNS)
    )


@query(
    "bucketed_after_index",
    f"""WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL}
    SELECT v.master, v.eid, v.ts, i.index_time FROM v JOIN (SELECT master, min(ts) AS index_time FROM idx GROUP BY master) i USING (master)
    WHERE v.ts > i.index_time""",
)
def bucketed_after_index(t):
    """Events after the index from two tables in the same buckets."""
    return _in_buckets(t).per_key(
        lambda tables: events_after_index(
            tables["events"].select("master", "eid", "ts"), tables["index"].withColumnRenamed("ts", "index_time"), "master", "ts", spread_by=["eid"]
        )
    )


_DATED_INDEX = f"""{fx.EVENTS_SQL}, {fx.INDEX_SQL},
    dated AS (SELECT master, eid, ts, txt FROM v WHERE ts IS NOT NULL), starts AS (SELECT DISTINCT master, eid, ts FROM idx)"""


def _index_times(t: Tables):
    return _index(t).select("master", "eid", "ts").distinct(), fx.events(t).frame.select("master", "eid", "ts", "txt")


@query(
    "nearest_before_index",
    f"""WITH {_DATED_INDEX}
    SELECT starts.master, starts.eid, starts.ts, e.eid AS eid_event, e.ts AS ts_event, e.txt AS txt_event FROM starts
    LEFT JOIN dated e ON e.master = starts.master AND e.ts < starts.ts
    QUALIFY row_number() OVER (PARTITION BY starts.master, starts.eid, starts.ts ORDER BY e.ts DESC, e.eid DESC) = 1""",
)
def nearest_before_index(t):
    """What was seen of a person last before the index event."""
    index, rows = _index_times(t)
    return as_of(index, rows, "master", index_time="ts", event_time="ts", order=["eid"], same_time=False)


@query(
    "nearest_after_index",
    f"""WITH {_DATED_INDEX}
    SELECT starts.master, starts.eid, starts.ts, e.eid AS eid_event, e.ts AS ts_event, e.txt AS txt_event FROM starts
    LEFT JOIN dated e ON e.master = starts.master AND e.ts > starts.ts AND e.ts <= starts.ts + INTERVAL 2 DAY
    QUALIFY row_number() OVER (PARTITION BY starts.master, starts.eid, starts.ts ORDER BY e.ts, e.eid) = 1""",
)
def nearest_after_index(t):
    """The first thing after it, within two days."""
    index, rows = _index_times(t)
    return as_of(
        index, rows, "master", index_time="ts", event_time="ts", direction="after", order=["eid"], same_time=False, within=2 * 86_400
    )


@query(
    "nearest_other_kind",
    f"""WITH {fx.EVENTS_SQL}, clicks AS (SELECT master, eid, ts FROM v WHERE txt LIKE 'click%'),
    bought AS (SELECT master, eid, ts FROM v WHERE txt LIKE 'purch%' AND ts IS NOT NULL),
    b AS (SELECT c.eid, max((e.ts, e.eid)) AS e FROM clicks c JOIN bought e ON c.master = e.master AND e.ts <= c.ts GROUP BY c.eid),
    a AS (SELECT c.eid, min((e.ts, e.eid)) AS e FROM clicks c JOIN bought e ON c.master = e.master AND e.ts >= c.ts GROUP BY c.eid)
    SELECT c.eid, c.master, c.ts,
      CASE WHEN b.e IS NULL OR a.e[1] - c.ts < c.ts - b.e[1] THEN a.e[2] ELSE b.e[2] END AS eid_event,
      CASE WHEN b.e IS NULL OR a.e[1] - c.ts < c.ts - b.e[1] THEN a.e[1] ELSE b.e[1] END AS ts_event
    FROM clicks c LEFT JOIN b USING (eid) LEFT JOIN a USING (eid)""",
)
def nearest_other_kind(t):
    """For every click of a person the purchase nearest to it; undated clicks have none."""
    rows = fx.events(t).frame
    clicks = rows.filter("txt LIKE 'click%'").select("eid", "master", "ts")
    bought = rows.filter("txt LIKE 'purch%'").select("eid", "master", "ts")
    return as_of(clicks, bought, "master", index_time="ts", event_time="ts", direction="nearest", order=["eid"])


@query(
    "events_around_index",
    f"""WITH {_DATED_INDEX}
    SELECT starts.master, starts.eid, starts.ts, e.eid AS eid_event, e.ts AS ts_event, e.txt AS txt_event FROM starts
    JOIN dated e ON e.master = starts.master AND e.ts BETWEEN starts.ts - INTERVAL 36 HOUR AND starts.ts + INTERVAL 5 DAY""",
)
def events_around_index(t):
    index, rows = _index_times(t)
    return events_within(index, rows, "master", index_time="ts", event_time="ts", before=36 * 3600, after=5 * 86_400)


@query(
    "sources_union_all",
    """SELECT source, txt, count(*) AS n FROM (
      SELECT 'error' AS source, event_type || props AS txt FROM events WHERE event_type = 'error'
      UNION ALL SELECT 'other', event_type || props FROM events WHERE event_type <> 'error')
    GROUP BY source, txt""",
)
def sources_union_all(t):
    rows = t.events.select("event_type", F.concat("event_type", "props").alias("txt"))
    both = union_sources(
        {"error": rows.filter("event_type = 'error'"), "other": rows.filter("event_type <> 'error'")}
    )
    return both.groupBy("source", "txt").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sources_union_distinct",
    """SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier""",
)
def sources_union_distinct(t):
    return (
        t.customer.select(F.col("c_nationkey").alias("nation"))
        .union(t.supplier.select(F.col("s_nationkey").alias("nation")))
        .distinct()
    )


_LINKED = f"""{fx.DIAGNOSES_SQL}, linked AS (
  SELECT d.*, p.person_id, p.MASTER_INDEX, p.segment
  FROM diag d JOIN orders o ON d.reg_id = o.o_orderkey JOIN pers p ON o.o_custkey = p.person_id)"""


@query(
    "linked_events",
    f"""WITH {_LINKED} SELECT reg_id, person_id, MASTER_INDEX, segment, disease, diag_time, l_partkey
    FROM linked WHERE disease LIKE 'R%F%' OR disease LIKE '%O 3%'""",
)
def linked_events(t):
    picked = fx.diagnoses(t).filter(any_like(F.col("disease"), ["R%F%", "%O 3%"]))
    rows = link_events(picked, fx.visits(t), canonical_person(fx.persons(t)), "reg_id", "person_id",
                       spread_by=["l_partkey", "l_linenumber"])
    return rows.select("reg_id", "person_id", "MASTER_INDEX", "segment", "disease", "diag_time", "l_partkey")


@query(
    "linked_first",
    f"""WITH {_LINKED}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY person_id
        ORDER BY diag_time ASC NULLS FIRST, l_linenumber, l_partkey, l_suppkey, reg_id) AS rn FROM linked)
    SELECT person_id, MASTER_INDEX, segment, disease, diag_time FROM ranked WHERE rn = 1""",
)
def linked_first(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "reg_id"]
    rows = link_extreme(
        fx.diagnoses(t), fx.visits(t), canonical_person(fx.persons(t)), "reg_id", "person_id", "diag_time", order
    )
    return rows.select("person_id", "MASTER_INDEX", "segment", "disease", "diag_time")


@query(
    "linked_last",
    f"""WITH {_LINKED}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY diag_time DESC NULLS LAST,
        l_linenumber DESC, l_partkey DESC, l_suppkey DESC, reg_id DESC) AS rn FROM linked)
    SELECT person_id, MASTER_INDEX, segment, disease, diag_time FROM ranked WHERE rn = 1""",
)
def linked_last(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "reg_id"]
    rows = link_extreme(
        fx.diagnoses(t), fx.visits(t), canonical_person(fx.persons(t)), "reg_id", "person_id", "diag_time", order, "max"
    )
    return rows.select("person_id", "MASTER_INDEX", "segment", "disease", "diag_time")


@query("linked_keys", f"WITH {_LINKED} SELECT DISTINCT MASTER_INDEX FROM linked WHERE disease LIKE 'R%F%7%'")
def linked_keys(t):
    picked = fx.diagnoses(t).filter(any_like(F.col("disease"), ["R%F%7%"]))
    return link_keys(picked, fx.visits(t), canonical_person(fx.persons(t)), "reg_id", "person_id", "MASTER_INDEX")


query("study_cohort", f"WITH {fx.STUDY_SQL} SELECT * FROM cohort")(
    lambda t: study_cohort(
        fx.study_diagnoses(t), fx.study_visits(t), fx.persons(t), index=fx.STUDY_INDEX,
        outcome=fx.STUDY_OUTCOME, excluded=fx.STUDY_EXCLUDED, visit="reg_id", columns=fx.STUDY_COLUMNS,
        required=["birthday"],
    )
)


_GAPS = """gaps AS (
  SELECT l_orderkey, l_partkey, l_linenumber, o_orderdate + to_hours(CAST(o_custkey % 24 AS INTEGER)) AS a,
         l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _gaps(t: Tables):
    def hours(col):
        return F.make_dt_interval(F.lit(0), (F.col(col) % 24).cast("int"))

    return fx.lines_with_orders(t).select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("o_orderdate") + hours("o_custkey")).alias("a"),
        (F.col("l_shipdate") + hours("l_partkey")).alias("b"),
    )


@query(
    "day_gap_calendar",
    f"""WITH {_GAPS} SELECT l_orderkey, l_partkey, l_linenumber,
      CAST(date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) AS INTEGER) AS gap FROM gaps""",
)
def day_gap_calendar(t):
    return _gaps(t).select("l_orderkey", "l_partkey", "l_linenumber", calendar_days(F.col("a"), F.col("b")).alias("gap"))


@query(
    "day_gap_elapsed",
    f"""WITH {_GAPS} SELECT l_orderkey, l_partkey, l_linenumber,
      CAST(floor((epoch_us(b) - epoch_us(a)) / 86400000000) AS BIGINT) AS gap FROM gaps""",
)
def day_gap_elapsed(t):
    return _gaps(t).select(
        "l_orderkey", "l_partkey", "l_linenumber", elapsed_days(F.col("a"), F.col("b")).cast("bigint").alias("gap")
    )


@query(
    "day_labels",
    f"""WITH {_GAPS} SELECT CASE WHEN date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) < 1 THEN -1 ELSE 1 END AS label,
      CAST(CAST(a AS DATE) AS VARCHAR) AS day, CAST(CAST(b AS DATE) AS VARCHAR) AS other_day, count(*) AS n FROM gaps GROUP BY 1, 2, 3""",
)
def day_labels(t):
    a, b = F.col("a"), F.col("b")
    day = calendar_date_of_text(F.date_format(b, "yyyy-MM-dd HH:mm:ss"))
    return (
        _gaps(t)
        .select(follow_up_label(calendar_days(a, b)).alias("label"), calendar_date(a).cast("string").alias("day"),
                day.cast("string").alias("other_day"))
        .groupBy("label", "day", "other_day")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "person_key_cast",
    "SELECT CAST(substr(c_name, 10) AS BIGINT) AS master, c_custkey FROM customer",
)
def person_key_cast(t):
    return t.customer.select(person_key(F.expr("substring(c_name, 10)")).alias("master"), "c_custkey")


@query(
    "index_frequency",
    f"WITH {fx.EVENTS_SQL}, {fx.INDEX_SQL} SELECT txt AS value, count(*) AS n FROM idx GROUP BY txt",
)
def index_frequency(t):
    return frequency(_index(t), "txt")
