"""Small cases with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry.functions.labels import encode, fill_missing, follow_up_label, person_key
from cohortry.functions.text import (
    any_like, ascii_brackets, clean_label, drop_bracket_prefix, drop_question_marks, excluded_code, like, strip_text,
)
from cohortry.functions.time import calendar_date_of_text, calendar_days, elapsed_days, years
from cohortry.functions.fixed_values import EXCLUDED_PATTERNS, INDEX_PATTERNS, OUTCOME_PATTERNS, SEX_CODES
from cohortry.operators.cohort import build_cohort, events_after_index, frequency
from cohortry.operators.events import (
    EventColumns, Events, first_occurrence, keys_matching, last_contact, milestones, rows_at_extreme,
)
from cohortry.operators.exposures import first_exposure
from cohortry.operators.sets import combine_first, drop_keys_where, exclude, first_per_key, keys_minus, restrict_to

T = dt.datetime
C = EventColumns(person="k", record="r", time="t", text="x", order=("id",))
SCHEMA = "id int, source string, k bigint, r bigint, t timestamp_ntz, x string"


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, fn, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.fixture
def two_sources(spark):
    rows = [
        (1, "out", 1, 1, None, "a"),
        (2, "out", 1, 1, T(2020, 1, 5), "a"),
        (3, "in", 1, 1, T(2020, 2, 1), "a"),
        (4, "out", 2, 2, T(2020, 3, 1, 10), "a"),
        (5, "in", 2, 2, T(2020, 3, 1, 10), "a"),
        (6, "in", 3, 3, None, "a"),
        (7, "in", None, 4, T(2020, 1, 1), "a"),
    ]
    return Events(spark.createDataFrame(rows, SCHEMA), ("out", "in"), C)


@pytest.mark.parametrize("per", ["person", "record"])
def test_missing_time_hides_its_source_and_ties_stay(two_sources, per):
    found = first_occurrence(two_sources, ["a"], per=per)
    assert sorted(r.id for r in found.collect()) == [3, 4, 5]
    dated = first_occurrence(two_sources, ["a"], per=per, null_times="drop")
    assert sorted(r.id for r in dated.collect()) == [2, 4, 5]


def test_last_contact_merges_equal_rows(two_sources, spark):
    found = {(r.k, r.t) for r in last_contact(two_sources).collect()}
    assert found == {(1, T(2020, 2, 1)), (2, T(2020, 3, 1, 10))}
    assert last_contact(two_sources).count() == 2
    only = last_contact(two_sources, spark.createDataFrame([(2,), (2,), (9,)], "k bigint"))
    assert [r.k for r in only.collect()] == [2]


def test_rows_at_extreme(spark):
    rows = spark.createDataFrame([(1, 3, "a"), (1, 3, "b"), (1, 5, "c"), (2, None, "d"), (None, 1, "e")], "k int, t int, v string")
    assert sorted(r.v for r in rows_at_extreme(rows, "k", "t").collect()) == ["a", "b"]
    assert sorted(r.v for r in rows_at_extreme(rows, "k", "t", "max").collect()) == ["c"]


def test_drop_all_rows_of_a_bad_key(spark):
    rows = spark.createDataFrame([(1, 1), (2, None), (2, 5), (3, 2)], "k int, b int")
    assert sorted(r.k for r in drop_keys_where(rows, "k", F.col("b").isNull()).collect()) == [1, 3]


def test_combine_first_multiplies_and_fills_cells(spark):
    left = spark.createDataFrame([(2, None, "a"), (2, None, None), (1, 7, None)], "k int, t int, x string")
    right = spark.createDataFrame([(2, 8, "p"), (2, 9, "q"), (3, 1, "r")], "k int, t int, x string")
    rows = sorted(tuple(r) for r in combine_first(left, right, "k", "left").select("k", "t", F.coalesce("x", F.lit(""))).collect())
    assert rows == [(1, 7, ""), (2, 8, "a"), (2, 8, "p"), (2, 9, "a"), (2, 9, "q")]
    assert sorted(r.k for r in combine_first(left, right, "k").collect()) == [1, 2, 2, 2, 2, 3]


def test_day_gaps(spark):
    rows = spark.createDataFrame(
        [(T(2020, 1, 1, 23), T(2020, 1, 2, 1)), (T(2020, 1, 1, 12), T(2020, 1, 1)), (T(2020, 1, 1), T(2020, 1, 3)),
         (T(2020, 1, 3), T(2020, 1, 1)), (T(2020, 1, 1), T(2019, 12, 31, 23, 59, 59, 999999)), (T(2020, 1, 1), None)],
        "a timestamp_ntz, b timestamp_ntz",
    )
    a, b = F.col("a"), F.col("b")
    found = [tuple(r) for r in rows.select(calendar_days(a, b), elapsed_days(a, b)).collect()]
    assert found == [(1, 0), (0, -1), (2, 2), (-2, -2), (-1, -1), (None, None)]


def test_elapsed_days_ignores_the_session_zone(spark):
    rows = spark.createDataFrame([(T(2021, 3, 27, 12), T(2021, 3, 28, 12))], "a timestamp_ntz, b timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert rows.select(elapsed_days(F.col("a"), F.col("b"))).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_labels_and_codes(spark):
    assert apply(spark, [0, 1, -3, None], follow_up_label, "int") == [-1, 1, -1, 1]
    assert apply(spark, ["男", "女", "?", None], lambda c: encode(c, SEX_CODES)) == [0, 1, None, None]
    assert apply(spark, ["12", None], person_key) == [12, None]
    assert apply(spark, ["a", None], lambda c: fill_missing(c, c, "空值")) == ["a", "空值"]
    assert apply(spark, [731, None], lambda c: F.round(years(c), 6), "int") == [round(731 / 365.2425, 6), None]
    with pytest.raises(Exception):
        apply(spark, ["x1"], person_key)


def test_code_heads(spark):
    codes = ["C02AA", "C01DA", " C10AA ", "C21", "C0", "C09", "C031"]
    assert apply(spark, codes, excluded_code) == [False, True, True, True, False, False, False]


def test_text_cleaning(spark):
    assert apply(spark, ["(甲)(乙)）药(丙)", "（a\rb)c", "(a\nb)c", "x(a)", "(a", None], drop_bracket_prefix) == [
        "(乙)）药(丙)", "c", "(a\nb)c", "x(a)", "(a", None]
    odd = "".join(map(chr, [0x3000, 0x1C, 0x85, 0x2028, 0x20])) + "x y" + "  \t"
    assert apply(spark, [odd, "　x ", ""], strip_text) == ["x y", "x", ""]
    assert apply(spark, ["a?b？"], drop_question_marks) == ["ab"]
    assert apply(spark, [" ?a ？ "], clean_label) == ["a "]
    assert apply(spark, ["红（大）(x)"], ascii_brackets) == ["红(大)(x)"]


def test_text_dates(spark):
    assert apply(spark, ["2020-02-03 23:59:59", "2020-02-03", None], calendar_date_of_text) == [
        dt.date(2020, 2, 3), dt.date(2020, 2, 3), None]


def test_pattern_sets(spark):
    names = ["原发性高血压", "HBP", "hbp", "难治性高血压", "妊娠期高血压", "冠状动脉粥样硬化性心脏病", "心房颤动", "CAD", "感冒", None]
    assert len(OUTCOME_PATTERNS) == 15
    assert apply(spark, names, lambda c: any_like(c, INDEX_PATTERNS)) == [
        True, True, False, True, True, False, False, False, False, None]
    assert apply(spark, names, lambda c: any_like(c, INDEX_PATTERNS, True))[2] is True
    assert apply(spark, names, lambda c: any_like(c, EXCLUDED_PATTERNS)) == [
        False, False, False, True, True, False, False, False, False, None]
    assert apply(spark, names, lambda c: any_like(c, OUTCOME_PATTERNS)) == [
        False, False, False, False, False, True, True, False, False, None]
    assert apply(spark, names, lambda c: any_like(c, OUTCOME_PATTERNS, True))[7] is True


def test_like_equals_spark_like(spark):
    import itertools

    texts = ["".join(p) for n in range(6) for p in itertools.product("ab房", repeat=n)]
    patterns = ["%a%b%", "a%b", "%a%a%", "a%a", "ab%ab", "%房%a", "房%a%", "%", "", "a", "a%", "%a", "%ab%b%a%", "a_%b", "%aa%a", "a%%b"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "v string")
    v = F.col("v")
    wrong = df.select(*[F.count_if(~like(v, p).eqNullSafe(v.like(p))).alias(f"p{i}") for i, p in enumerate(patterns)]).first()
    assert list(wrong) == [0] * len(patterns)


def test_frequency_skips_missing(spark):
    assert [tuple(r) for r in frequency(column(spark, ["a", None, "a", "b"]), "v").collect()] == [("a", 2), ("b", 1)]


def test_sets(spark):
    a, b = (spark.createDataFrame([(v,) for v in vs], "k bigint") for vs in ([1, 1, 2, None], [2, 3, None]))
    assert [r.k for r in keys_minus(a, b, "k").collect()] == [1]
    assert [r.k for r in restrict_to(a, b, "k").collect()] == [2]
    assert sorted(r.k or 0 for r in exclude(a, b, "k").collect()) == [0, 1, 1]
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 3, None)], "k string, o int, v string")
    assert sorted(tuple(r)[:2] for r in first_per_key(rows, "k", F.col("o")).collect()) == [("x", 1), ("y", 3)]
    assert sorted(tuple(r)[:2] for r in first_per_key(rows, "k", F.col("o"), last=True).collect()) == [("x", 2), ("y", 3)]


def test_first_exposure(spark):
    rows = spark.createDataFrame(
        [(1, T(2020, 1, 2), "C02"), (1, None, "C02"), (1, T(2020, 1, 1), " C10 "), (2, T(2020, 1, 1), "C01")],
        "k int, t timestamp_ntz, c string")
    found = first_exposure(rows, person="k", time="t", code="c")
    assert [tuple(r) for r in found.collect()] == [(1, T(2020, 1, 2))]


def test_events_after_index_are_strictly_later(spark):
    events = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "k int, t int")
    cohort = spark.createDataFrame([(1, 2), (1, 2)], "k int, index_time int")
    assert [tuple(r) for r in events_after_index(events, cohort, "k", "t").collect()] == [(1, 3, 2)]


@pytest.fixture
def small_cohort(spark):
    born = T(1960, 1, 1)
    index = spark.createDataFrame(
        [(1, T(2020, 1, 1, 23), "i", born), (2, T(2020, 1, 1), "i", born), (3, T(2020, 1, 1), "i", born),
         (4, T(2020, 1, 1), "i", None), (4, T(2020, 1, 1), "j", born), (5, T(2020, 1, 1), "i", born),
         (6, T(2020, 1, 1), "i", born)],
        "k bigint, t timestamp_ntz, x string, born timestamp_ntz")
    kind = "k bigint, t timestamp_ntz, x string"
    outcome = spark.createDataFrame([(1, T(2020, 1, 2, 1), "o"), (2, T(2020, 1, 1, 9), "o"), (2, T(2020, 1, 1, 9), "p"), (9, T(2020, 1, 1), "o")], kind)
    contact = spark.createDataFrame([(1, T(2021, 1, 1), "c"), (3, T(2020, 6, 1), "c"), (3, T(2020, 6, 1), "d")], kind)
    excluded = spark.createDataFrame([(5,), (77,), (None,)], "k bigint")
    return build_cohort(index, outcome, excluded, contact, C, ["born"])


def test_build_cohort(small_cohort):
    found = sorted((r.k, r.end_text or "", r.observed, r.gap_days, r.label) for r in small_cohort.collect())
    assert found == [
        (1, "o", True, 1, 1), (2, "o", True, 0, -1), (2, "p", True, 0, -1),
        (3, "c", False, 152, 1), (3, "d", False, 152, 1), (6, "", False, None, 1),
    ]


def test_cohort_properties_and_partition_independence(spark, data):
    from cohortry.plans import fixtures as fx
    from cohortry.plans.cohorts import cohort
    from cohortry.plans.registry import Tables

    t = Tables(spark, data)
    direct = build_cohort(
        first_occurrence(fx.events(t), fx.INDEX).select("master", "ts", "txt", "birthday"),
        first_occurrence(fx.events(t), fx.OUTCOME, per="record"),
        keys_matching(fx.events(t), fx.EXCLUDED), last_contact(fx.events(t)), fx.COLUMNS, ["birthday"])
    rows = sorted(map(str, direct.select(sorted(direct.columns)).collect()))
    assert rows
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        reduced = cohort(t)
        assert sorted(map(str, reduced.select(sorted(reduced.columns)).collect())) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert direct.filter("(gap_days >= 1) != (label = 1)").count() == 0
    assert direct.join(keys_matching(fx.events(t), fx.EXCLUDED), "master").count() == 0


def test_milestones_read_events_once(two_sources):
    parts = milestones(two_sources, {"a": None, "z": F.col("x") == "z"}, latest=["a"])
    assert parts["z"].frame.count() == 0
    assert sorted(r.id for r in parts["a"].frame.collect()) == [2, 3, 4, 5, 6]
    for null_times, ids in (("first", [3, 4, 5]), ("drop", [2, 4, 5])):
        part = milestones(two_sources, {"a": F.col("x") == "a"}, null_times=null_times)["a"]
        assert sorted(r.id for r in first_occurrence(part).collect()) == ids
        assert sorted(r.id for r in first_occurrence(part, per="record").collect()) == ids
        # a person known only from an event without a time is still a match
        assert sorted(r.k for r in keys_matching(part, ["a"]).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        first_occurrence(milestones(two_sources, {"a": None})["a"], null_times="drop")
