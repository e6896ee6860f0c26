"""Counts after every step of a chain."""

import random

from pyspark.sql import functions as F

from cohortry.operators import steps as steps_module
from cohortry.operators.steps import Steps


def data(spark, n=600):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 1, 2, 3, 4, 5, None]), i, draw.choice([None, 0, 1, 2])) for i in range(n)]
    rows = [(*r, r[0] in (1, 3, None) and r[1] % 9 == 0) for r in rows]
    return rows, spark.createDataFrame(rows, "person int, i int, v int, bad boolean")


def test_counts_and_rows(spark):
    rows, frame = data(spark)
    out = spark.createDataFrame([(2,), (2,), (None,), (9,)], "person int")
    result, report = (
        Steps(frame, "person", "all").keep("v known", F.col("v") >= 0).without_keys("not out", out)
        .drop_keys_where("none bad", F.col("bad")).keep("v positive", F.col("v") > 0)
        .with_keys("in", spark.createDataFrame([(3,), (4,), (5,), (5,)], "person int")).done()
    )
    kept = [rows]
    kept.append([r for r in kept[-1] if r[2] is not None])
    kept.append([r for r in kept[-1] if r[0] != 2])
    bad = {r[0] for r in kept[-1] if r[3]}
    kept.append([r for r in kept[-1] if r[0] is None or r[0] not in bad])
    kept.append([r for r in kept[-1] if r[2] > 0])
    kept.append([r for r in kept[-1] if r[0] in (3, 4, 5)])
    assert len(kept[3]) < len(kept[2]) and kept[-1]
    assert [tuple(r) for r in report.orderBy("step_no").collect()] == [
        (i, name, len(k), len({r[0] for r in k} - {None}))
        for i, (name, k) in enumerate(zip(["all", "v known", "not out", "none bad", "v positive", "in"], kept), 1)
    ]
    assert sorted(tuple(r) for r in result.collect()) == sorted(kept[-1]) and result.columns == frame.columns


def test_the_chain_runs_once(spark, monkeypatch):
    """One write, in which every row is met once."""
    runs = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def met(i):
        runs.add(1)
        return i

    writes = []
    real = steps_module.written
    monkeypatch.setattr(steps_module, "written", lambda df, name: writes.append(name) or real(df, name))
    frame = spark.range(100).select((F.col("id") % 7).alias("person"), met("id").alias("i"))
    result, report = Steps(frame, "person", "all").keep("even", F.col("i") % 2 == 0).keep("small", F.col("i") < 50).done()
    assert [r.n_rows for r in report.orderBy("step_no").collect()] == [100, 50, 25]
    assert result.count() == 25 and len(writes) == 1 and runs.value == 100


def test_empty_frame(spark):
    frame = spark.createDataFrame([], "person int, v int")
    result, report = Steps(frame, "person", "all").keep("v", F.col("v") > 0).without_keys("out", frame).done()
    assert [(r.n_rows, r.n_persons) for r in report.collect()] == [(0, 0)] * 3 and result.count() == 0
