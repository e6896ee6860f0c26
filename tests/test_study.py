"""The whole study on random clinical tables against a plain restatement of its rules."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from cohortry.operators.cohort import study_cohort
from cohortry.operators.exposures import exposures, first_exposure, first_exposure_of_charges
from cohortry.operators.linking import visit_persons

DAY = dt.datetime(2020, 1, 1)
DISEASES = ["原发性高血压", "HBP", "难治性高血压", "心房颤动", "慢性肾功能衰竭", "感冒", "CKD 3", "高血压"]


def tables(seed):
    rng = random.Random(seed)
    persons = [(p, f"m{p}", str(rng.randint(0, 14)), None if rng.random() < 0.1 else dt.datetime(1950, 1, 1), rng.choice("男女"))
               for p in range(25)]
    sources = {}
    for name in ("out", "in"):
        # the first record owns a third of the visits
        visits = [(v, rng.choice([0, *range(25), *range(25)]) if rng.random() > 0.3 else 0) for v in range(80)]
        diagnoses = []
        for v, _ in visits:
            for _ in range(rng.choice([1, 1, 2, 3])):
                time = None if rng.random() < 0.08 else DAY + dt.timedelta(hours=rng.randint(0, 60) * 12)
                diagnoses.append((v, rng.choice(DISEASES), time))
        sources[name] = (visits, diagnoses)
    return persons, sources


def like(text, parts):
    at = 0
    for part in parts:
        at = text.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return True


INDEX = [["高血压"], ["HBP"]]
EXCLUDED = [["难治", "高血压"]]
OUTCOME = [["房", "颤"], ["肾", "衰"], ["CKD"]]


def restated(persons, sources, null_times):
    person_of = {p[0]: int(p[2]) for p in persons}
    born = {p[0]: p[3] for p in persons}
    events = [(s, dict(visits)[v], person_of[dict(visits)[v]], text, time, v)
              for s, (visits, diagnoses) in sources.items() for v, text, time in diagnoses]

    def firsts(patterns, key):
        groups = defaultdict(list)
        for e in events:
            if any(like(e[3], p) for p in patterns) and (e[4] is not None or null_times == "first"):
                groups[e[0], e[key]].append(e)
        # a missing time is the earliest and hides the rest of its group
        picked = [min(g, key=lambda e: (e[4] is not None, e[4] or DAY, e[3], e[5])) for g in groups.values()]
        dated = [e for e in picked if e[4] is not None]
        earliest = defaultdict(lambda: dt.datetime.max)
        for e in dated:
            earliest[e[2]] = min(earliest[e[2]], e[4])
        return [e for e in dated if e[4] == earliest[e[2]]]

    index, outcome = firsts(INDEX, 2), firsts(OUTCOME, 1)
    gone = {e[2] for e in events if any(like(e[3], p) for p in EXCLUDED)}
    gone |= {e[2] for e in index if born[e[1]] is None}
    latest = defaultdict(list)
    for e in events:
        if e[4] is not None:
            latest[e[0], e[1]].append(e)
    contact = [max(g, key=lambda e: (e[4], e[3], e[5])) for g in latest.values()]
    last = {m: max(e[4] for e in contact if e[2] == m) for m in {e[2] for e in contact}}
    ends = defaultdict(set)
    for e in contact:
        if e[4] == last[e[2]]:
            ends[e[2]].add((e[4], e[3]))
    rows = []
    for e in index:
        if e[2] in gone:
            continue
        found = [(o[4], o[3], True) for o in outcome if o[2] == e[2]]
        for time, text, seen in found or [(t, x, False) for t, x in ends[e[2]]]:
            gap = (time.date() - e[4].date()).days
            rows.append((e[2], e[4], e[3], time, text, seen, gap, -1 if gap < 1 else 1))
    return sorted(rows)


@pytest.mark.parametrize("null_times", ["first", "drop"])
@pytest.mark.parametrize("seed", [1, 2])
def test_study_cohort(spark, seed, null_times):
    persons, sources = tables(seed)
    visits = {s: spark.createDataFrame(v, "REG_ID int, PERSON_ID int") for s, (v, _) in sources.items()}
    diagnoses = {s: spark.createDataFrame(d, "REG_ID int, DISEASE_NAME string, DIAG_TIME timestamp_ntz") for s, (_, d) in sources.items()}
    people = spark.createDataFrame(
        persons, "PERSON_ID int, MASTER_INDEX string, MASTER_INDEX2 string, BIRTHDAY timestamp_ntz, SEX string")
    found = study_cohort(diagnoses, visits, people, null_times=null_times)
    rows = sorted(
        (r.MASTER_INDEX, r.index_time, r.index_text, r.end_time, r.end_text, r.observed, r.gap_days, r.label) for r in found.collect()
    )
    expected = restated(persons, sources, null_times)
    assert rows == expected and expected
    assert {"SEX", "BIRTHDAY", "PERSON_ID"} <= set(found.columns)


def test_first_exposure_before_and_after_linking(spark):
    rng = random.Random(4)
    charges = spark.createDataFrame(
        [(rng.randint(0, 40), rng.choice("abcd"), None if rng.random() < 0.2 else DAY + dt.timedelta(days=rng.randint(0, 99)))
         for _ in range(400)], "v int, item string, t timestamp_ntz")
    codes = spark.createDataFrame([("a", "C02"), ("a", "C03"), ("b", " C02"), ("c", "C10 "), ("d", "C09")], "item string, code string")
    visits = spark.createDataFrame([(v, rng.randint(0, 12)) for v in range(38)], "v int, p int")
    people = spark.createDataFrame([(p, p // 2 if p else None) for p in range(11)], "p int, m int")
    linked = visit_persons(visits, people, "v", "p")
    names = dict(item="item", code="code", visit="v")
    every = exposures(charges, codes, linked, **names)
    assert every.filter("item = 'b'").count() == 0
    late = first_exposure(every, person="m", time="t", code="code")
    early = first_exposure_of_charges(charges, codes, linked, person="m", time="t", **names)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))
    assert late.count() > 3
