"""Tables in buckets, and rows from cursors."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators.cohort import events_after_index
from cohortry.operators.events import EventColumns, Events, first_occurrence, keys_matching
from cohortry.operators.sets import restrict_to
from cohortry.sources import records
from cohortry.sources.bucketed import store_bucketed
from cohortry.sources.records import read_records
from cohortry.sources.shared import remove_written

COLUMNS = EventColumns(person="person", record="person", time="t", text="txt", source="source", order=("i",))


def events(spark, hot):
    person = "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 40 END" if hot else "id % 40"
    return spark.range(4000).selectExpr(
        f"{person} AS person", "id AS i", "(id * 7919) % 1009 AS t", "concat(CASE WHEN id % 5 = 0 THEN 'index ' ELSE 'other ' END, id % 9) AS txt",
        "CASE WHEN id % 2 = 0 THEN 'out' ELSE 'in' END AS source",
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [False, True])
def test_same_rows_without_a_shuffle(spark, hot):
    frame = events(spark, hot)
    index = frame.filter("txt LIKE 'index 5%'").select("person", "t").groupBy("person").agg(F.min("t").alias("index_time"))
    stored = store_bucketed({"events": frame, "index": index}, "person", 16, {"events": ["t"]})
    assert (stored.hot is not None) == hot
    if hot:
        assert [r.person for r in stored.hot["events"].select("person").distinct().collect()] == [7]
        assert stored.cold["events"].filter("person = 7").count() == 0

    def of(tables):
        return Events(tables["events"], ("out", "in"), COLUMNS)

    works = {
        "first": lambda tables: first_occurrence(of(tables), ["index%"]),
        "keys": lambda tables: keys_matching(of(tables), ["%8"]),
        "after": lambda tables: events_after_index(tables["events"], tables["index"], "person", "t", spread_by=["i"]),
        "restricted": lambda tables: restrict_to(tables["events"], tables["index"], "person"),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, work in works.items():
            cold = work(stored.cold)
            assert "Exchange" not in plan(cold), name
            assert "Bucketed: true" in plan(cold) or "SelectedBucketsCount" in plan(cold), name
            want = sorted(map(tuple, work({"events": frame, "index": index}).select(*cold.columns).collect()), key=str)
            assert sorted(map(tuple, stored.per_key(work).collect()), key=str) == want, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_file_per_bucket_and_removal(spark):
    remove_written(spark)
    stored = store_bucketed({"events": events(spark, False)}, "person", 4, {"events": ["t"]})
    assert len(stored.cold["events"].inputFiles()) <= 4 and stored.cold["events"].count() == 4000
    assert remove_written(spark) >= 1


class Cursor:
    """Answers `rows <low> <high>` with numbers, in another order of columns than asked for."""

    description = None

    def execute(self, statement, args=None):
        low, high = args or (0, 3)
        assert statement == "rows"
        self.description = [("NAME", None), ("extra", None), ("Id", None)]
        self.rows = iter([(None if i % 4 == 0 else f"药{i}", "x", i) for i in range(low, high)])

    def fetchmany(self, n):
        assert n == 10
        return [r for _, r in zip(range(n), self.rows)]

    def close(self):
        self.rows = None


class Connection:
    def cursor(self):
        return Cursor()

    def close(self):
        pass


def test_records_of_a_cursor(spark):
    # the connection is made in the tasks, by a function that brings its classes along
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        ranges = [(0, 25), (25, 25), (25, 100)]
        found = read_records(spark, lambda: Connection(), "rows", "id bigint, name string", ranges, fetch=10)
        assert found.rdd.getNumPartitions() == 3
        rows = {r.id: r.name for r in found.collect()}
        assert rows == {i: None if i % 4 == 0 else f"药{i}" for i in range(100)}
        one = read_records(spark, lambda: Connection(), "rows", "name string, id int", fetch=10)
        assert [tuple(r) for r in one.collect()] == [(None, 0), ("药1", 1), ("药2", 2)]
        with pytest.raises(Exception, match="no columns"):
            read_records(spark, lambda: Connection(), "rows", "missing int", fetch=10).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def test_described_rows():
    cursor = Cursor()
    cursor.execute("rows", (0, 25))
    parts = list(records.described_rows(cursor, 10))
    assert [len(rows) for _, rows in parts] == [10, 10, 5] and parts[0][0] == ["NAME", "extra", "Id"]
