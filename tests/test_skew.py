"""Joins with hot keys: same rows as a plain join, and no task with most of them."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators.skew import BroadcastLimit, fits, hot_keys, lookup_join, skew_join


@pytest.fixture(scope="module")
def frames(spark):
    # a third of the rows has key 7, some have none, and many rows are copies
    left = spark.range(0, 30_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 != 0, F.col("id") % 997).cast("int").alias("k"),
        (F.col("id") % 5).alias("v"),
    )
    right = spark.range(0, 900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    right = right.union(spark.createDataFrame([(7, -1), (None, -2)], "k bigint, w bigint"))
    return left, right


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def sixteen_tasks(spark):
    """Plain shuffles into 16 tasks: nothing but the operators spreads a hot key."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_as_plain_join(sixteen_tasks, frames, how):
    left, right = frames
    assert hot_keys(left, "k")
    plain = left.withColumn("k", F.col("k").cast("bigint")).join(right, "k", how)
    spread = skew_join(left, right, "k", how).withColumn("k", F.col("k").cast("bigint"))
    assert spread.columns == plain.columns
    assert rows(spread) == rows(plain)


def test_text_and_composite_keys(frames):
    left, right = frames
    a = left.withColumn("s", F.concat(F.lit("n"), F.col("k").cast("string")))
    b = right.withColumn("s", F.concat(F.lit("n"), F.col("k").cast("string"))).select("s", "w")
    assert rows(skew_join(a, b, "s")) == rows(a.join(b, "s"))
    c = a.withColumn("g", F.col("v") % 2)
    d = b.withColumn("g", F.col("w") % 2)
    assert rows(skew_join(c, d, ["s", "g"])) == rows(c.join(d, ["s", "g"]))


def test_fraction_keys_take_the_plain_join(frames):
    left, right = frames
    a, b = left.withColumn("k", F.col("k") / 2), right.withColumn("k", F.col("k") / 2)
    assert rows(skew_join(a, b, "k")) == rows(a.join(b, "k"))


def test_hot_key_is_spread(spark, frames):
    left, right = frames
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)

        def largest(df):
            return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        right = right.dropDuplicates(["k"])
        total = left.filter("k is not null").count()
        assert largest(left.join(right.withColumn("k", F.col("k").cast("int")), "k")) > total * 0.33
        assert largest(skew_join(left, right, "k", spread_by=["v"])) < total * 0.2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_key_of_half_a_percent_is_hot_for_many_tasks(spark):
    left = spark.range(100_000).select(F.when(F.col("id") % 200 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert hot_keys(left, "k", tasks=16) == {}
    found = hot_keys(left, "k", tasks=1000)
    # 500 rows are five mean tasks
    assert len(found) == 1 and list(found.values()) == [40]


def test_clustered_key_and_repeated_right_rows(spark, sixteen_tasks):
    # the hot key lies in one input partition, and the right side has it three times
    left = spark.range(0, 30_000, 1, 3).select(
        F.when(F.col("id") < 10_000, F.lit(5)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 30_000, 7).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    right = right.unionByName(spark.createDataFrame([(5, "a"), (5, "b"), (5, "c")], "k bigint, w string"))
    joined = skew_join(left.coalesce(3), right, "k", "left")
    assert rows(joined) == rows(left.join(right, "k", "left"))
    assert max(sizes(joined)) < 3 * joined.count() / 16


def test_no_hot_key_means_a_plain_join(spark):
    left = spark.range(10_000).select((F.col("id") % 5000).alias("k"))
    right = spark.range(5000).select(F.col("id").alias("k"))
    assert hot_keys(left, "k") == {}
    assert "__salt" not in skew_join(left, right, "k")._jdf.queryExecution().toString()


def test_empty_sides(spark, frames):
    left, right = frames
    assert hot_keys(left.limit(0), "k") == {}
    assert skew_join(left.limit(0), right, "k").count() == 0
    assert skew_join(left, right.limit(0), "k", "left").count() == left.count()


def test_lookup_limit(spark, frames):
    left, right = frames
    left = left.withColumn("k", F.col("k").cast("bigint"))
    assert fits(right) and not fits(right, BroadcastLimit(rows=10)) and not fits(right, BroadcastLimit(bytes=100))
    small = lookup_join(left, right, "k", "inner")
    large = lookup_join(left, right, "k", "inner", BroadcastLimit(rows=10))
    assert rows(small) == rows(large)


def test_unsupported_join_is_refused(frames):
    with pytest.raises(ValueError):
        skew_join(*frames, "k", "full")


def ties(spark, n):
    """A third of all records belongs to one person and all have the same time."""
    from cohortry.operators.events import EventColumns, Events

    c = EventColumns(person="k", record="r", time="t", text="x", source="s", order=("r",))
    hot = F.col("r") % 3 == 0
    frame = spark.range(0, n, 1, 8).withColumnRenamed("id", "r").select(
        "r", F.when(hot, F.lit(0)).otherwise(F.col("r")).alias("k"), F.lit("one").alias("s"),
        F.when(hot, F.lit("2020-01-02")).otherwise(F.lit("2020-01-01")).cast("timestamp_ntz").alias("t"),
        F.concat(F.lit("x"), F.col("r").cast("string")).alias("x"))
    return Events(frame, ("one",), c)


def test_large_ties_of_one_person_are_spread(spark, sixteen_tasks):
    from cohortry.operators.cohort import build_cohort, cohort_of
    from cohortry.operators.events import first_occurrence, last_contact, milestones

    n = 9_000
    events = ties(spark, n)
    found = milestones(events, {"index": None, "outcome": None, "excluded": F.lit(False), "contact": None}, ["contact"])
    index = events.frame.groupBy("k").agg(F.min("t").alias("t"), F.min("x").alias("x"))
    nobody = events.frame.filter("false")
    outcomes = first_occurrence(events, per="record")
    results = {
        "reduced": first_occurrence(found["outcome"], per="record"), "raw": outcomes, "contact": last_contact(events),
        "milestones": cohort_of(found), "frames": build_cohort(index, outcomes, nobody, last_contact(events), events.columns),
    }
    for name, df in results.items():
        found = sizes(df)
        assert sum(found) == n, name
        assert max(found) < n * 0.2, name


def test_many_equal_outcomes(spark, sixteen_tasks):
    """Copies of one text keep their number without an array or a task that holds all of them."""
    from cohortry.operators.cohort import cohort_of
    from cohortry.operators.events import Events, milestones

    n = 6_000
    events = ties(spark, n)
    events = Events(events.frame.withColumn("x", F.lit("same")), ("one",), events.columns)
    found = milestones(events, {"index": None, "outcome": None, "excluded": F.lit(False), "contact": None}, ["contact"])
    df = cohort_of(found)
    found = sizes(df)
    assert sum(found) == n and max(found) < n * 0.25


def test_collated_keys(spark):
    """Equal keys that differ in their bytes meet, also if one of them is hot."""
    from cohortry.functions.collation import collated_like, plain_text, under_collation

    left = spark.createDataFrame([("Abc" if i % 2 else "aBC  ", i) for i in range(300)] + [("x", -1), (None, -2)], "k string, i int")
    right = spark.createDataFrame([("ABC", 10), ("Y", 11)], "k string, v int")
    a, b = under_collation(left, ["k"]), under_collation(right, ["k"])
    assert skew_join(a, b, "k").count() == 300
    assert skew_join(a, b, "k", hot=hot_keys(left, "k", tasks=50)).count() == 300
    assert skew_join(a, b, "k", "left").filter("v IS NULL").count() == 2
    assert a.select("k").distinct().count() == 3
    assert a.filter(collated_like(F.col("k"), ["%BC", "X"])).count() == 151
    assert plain_text(a, ["k"]).select("k").distinct().count() == 4
