"""How often a query reads its tables."""

import re

from cohortry.plans import QUERIES
from cohortry.plans.registry import Tables


def test_study_reads_each_table_once(spark, data, monkeypatch):
    """The plan that reduces the events scans line items, parts and orders once each."""
    from cohortry.operators import events
    from cohortry.plans import cohorts  # noqa: F401

    plans = []
    original = events._written

    def seen(reduced, *rest):
        plans.append(reduced._jdf.queryExecution().optimizedPlan().toString())
        return original(reduced, *rest)

    monkeypatch.setattr(events, "_written", seen)
    QUERIES["study_cohort"](spark, data)
    (plan,) = plans
    relations = re.findall(r"Relation \[(\w+)#", plan)
    # visits of both sources are the same orders table
    assert relations.count("l_orderkey") == 1 and relations.count("p_partkey") == 1


def test_attrition_is_one_aggregate_over_the_milestones(spark, data):
    plan = QUERIES["attrition"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Relation ", plan)) == 2  # persons, and counted ends


def test_tables_are_read_when_used(spark, data):
    assert Tables(spark, data).region.count() == 5
