"""Values around a time against plain Python, with persons that hold most of the rows."""

import datetime as dt
import random

import pytest

from cohortry.operators.asof import DIRECTIONS, as_of, events_within
from cohortry.operators.skew import hot_keys

START = dt.datetime(2024, 3, 30)


def rows(n, seed, span):
    """(person, minutes, number); person 0 holds a half, some have no time or no person."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        person = draw.choice([0, 0, 0, 1, 2, 3, None]) if i % 50 else 99
        out.append((person, None if draw.random() < 0.05 else draw.randrange(span), i))
    return out


def nearest(person, at, events, direction, same_time, within):
    if person is None or at is None:
        return None
    own = [(t, k) for p, t, k in events if p == person and t is not None and (same_time or t != at)]
    before = max((e for e in own if e[0] <= at), default=None)
    after = min((e for e in own if e[0] >= at), default=None)
    if direction == "nearest":
        found = before if before and (after is None or at - before[0] <= after[0] - at) else after
    else:
        found = before if direction == "before" else after
    return found if found and (within is None or abs(found[0] - at) <= within) else None


def frame(spark, data, numeric):
    if numeric:
        return spark.createDataFrame(data, "person bigint, t bigint, k int")
    moved = [(p, None if m is None else START + dt.timedelta(minutes=m), k) for p, m, k in data]
    return spark.createDataFrame(moved, "person bigint, t timestamp_ntz, k int")


@pytest.mark.parametrize("direction", DIRECTIONS)
@pytest.mark.parametrize("same_time,within,numeric,hot", [
    (True, None, False, False), (False, 30, False, True), (True, 5, True, True), (False, None, True, True),
])
def test_as_of(spark, direction, same_time, within, numeric, hot):
    index, events = rows(300, 1, 400), rows(500, 2, 400)
    index += index[:20]
    i, e = frame(spark, index, numeric), frame(spark, events, numeric)
    keys = hot_keys(e, "person", tasks=20) if hot else {}
    assert bool(keys) == hot
    found = as_of(
        i, e, "person", index_time="t", event_time="t", direction=direction, order=["k"], same_time=same_time,
        within=within if within is None or numeric else within * 60, hot=keys,
    )
    assert found.columns == ["person", "t", "k", "t_event", "k_event"]

    def minutes(t):
        return t if t is None or numeric else int((t - START).total_seconds()) // 60

    got = sorted(((r.person, minutes(r.t), r.k, minutes(r.t_event), r.k_event) for r in found.collect()), key=str)
    want = sorted((((p, t, k) + (nearest(p, t, events, direction, same_time, within) or (None, None))) for p, t, k in index), key=str)
    assert got == want


def test_no_events_and_ties_without_an_order(spark):
    index = frame(spark, [(1, 10, 0), (2, 10, 1)], True)
    assert as_of(index, index.limit(0), "person", index_time="t", event_time="t").filter("t_event IS NULL").count() == 2
    events = frame(spark, [(1, 5, 3), (1, 5, 9), (1, 5, 4)], True)
    assert as_of(index, events, "person", index_time="t", event_time="t").orderBy("k").first().k_event == 9
    assert as_of(events, events.limit(0), "person", index_time="t", event_time="t", direction="nearest").count() == 3
    with pytest.raises(ValueError):
        as_of(index, events, "person", index_time="t", event_time="t", direction="sideways")


def test_a_hot_person_is_cut_by_time(spark):
    """No window of the plan holds more than a part of the person's rows, and the events are shuffled once per direction."""
    events = spark.range(20_000).selectExpr("CASE WHEN id % 10 < 8 THEN 0 ELSE id END AS person", "id AS t", "id AS k")
    index = events.filter("k % 7 = 0")
    hot = hot_keys(events, "person", tasks=50)
    found = as_of(index, events, "person", index_time="t", event_time="t", order=["k"], same_time=False, hot=hot)
    assert found.filter("person = 0 AND k_event IS NULL").count() == 1
    assert found.filter("person = 0 AND k_event NOT BETWEEN t - 3 AND t - 1").count() == 0
    from cohortry.operators import asof
    from pyspark.sql import functions as F

    times = events.select("person", F.col("t").alias(asof._TIME))
    cut = asof._cut(times, ["person"], asof._pieces(times, ["person"], hot))
    sizes = [r["count"] for r in cut.filter("person = 0").groupBy(asof._PIECE).count().collect()]
    assert sum(sizes) == 16_000 and max(sizes) < 16_000 * 3 / len(sizes) and len(sizes) > 100


@pytest.mark.parametrize("before,after", [(0, 0), (90 * 60, 3600), (3 * 86_400, 0), (0, 40 * 86_400)])
def test_events_within(spark, before, after):
    index, events = rows(120, 3, 9000), rows(300, 4, 9000)
    index.append(index[0])
    found = events_within(
        frame(spark, index, False), frame(spark, events, False), "person", index_time="t", event_time="t", before=before, after=after
    )
    got = sorted((r.k, r.k_event) for r in found.collect())
    want = sorted(
        (k, ek) for p, t, k in index for ep, et, ek in events
        if p is not None and p == ep and t is not None and et is not None and t - before / 60 <= et <= t + after / 60
    )
    assert got == want
