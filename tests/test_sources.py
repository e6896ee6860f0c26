"""Readers and writers. JDBC is covered up to its options: no database may run here."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources import shared
from cohortry.sources.tables import (
    first_row, jdbc_options, query, read_csv, read_csv_checked, read_dictionary, read_table, write_csv, write_table,
)


def test_dictionary_csv_keeps_file_order_and_ignores_the_mark(spark, tmp_path):
    path = tmp_path / "names.csv"
    words = [("红片", "C02"), (" 蓝 ", "C03"), ("红片", "")] + [(f"药{i}", f"C{i}") for i in range(500)]
    path.write_text("medical_name,atc\n" + "".join(f'"{a}",{b}\n' for a, b in words), encoding="utf-8-sig")
    rows = read_dictionary(spark, str(path)).orderBy("ord").collect()
    assert [(r.medical_name, r.atc or "") for r in rows] == words


def test_split_csv_keeps_file_order(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("medical_name,atc\n" + "".join(f"name{i},C{i}\n" for i in range(20_000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        df = read_dictionary(spark, str(path))
        assert df.rdd.getNumPartitions() > 4
        rows = df.repartition(7).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.medical_name for r in rows] == [f"name{i}" for i in range(20_000)]


def test_quoted_fields(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('medical_name,atc\n"a ""b"" c, d",C1\n"two\nlines",C2\nends\\,C3\n', encoding="utf-8-sig")
    found = read_dictionary(spark, str(path), line_breaks=True).orderBy("ord").collect()
    assert [(r.medical_name, r.atc) for r in found] == [('a "b" c, d', "C1"), ("two\nlines", "C2"), ("ends\\", "C3")]


MIXED = "k,name\n1,a\n2,b,c\nx,d\n4\n5,\"q, r\"\n\n6,\n"
PAIRS = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType())])


@pytest.mark.parametrize("line_breaks", [False, True])
def test_rows_that_do_not_fit_are_set_apart(spark, tmp_path, line_breaks):
    (tmp_path / "a.csv").write_text(MIXED, encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("k,name\n7,g\n", encoding="utf-8")
    rows = read_csv_checked(spark, str(tmp_path), PAIRS, order="ord", line_breaks=line_breaks)
    assert write_table(rows.fitting.select("k", "name"), str(tmp_path / "fitting")) == 4
    assert rows.counts() == (7, 3)
    kept = read_table(spark, str(tmp_path / "fitting")).orderBy("k").collect()
    assert [(r.k, r.name) for r in kept] == [(1, "a"), (5, "q, r"), (6, None), (7, "g")]
    found = rows.misfits.orderBy("text").collect()
    assert [r.text.strip() for r in found] == ["2,b,c", "4", "x,d"] and all(r.file.endswith("a.csv") for r in found)
    # whichever columns are asked for
    assert rows.misfits.select("text").count() == rows.misfits.count() == 3
    assert rows.fitting.select("name").count() == 4


def test_strict_reading_fails_at_a_row_that_does_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text(MIXED, encoding="utf-8")
    (tmp_path / "good.csv").write_text("k,name\n1,a\n", encoding="utf-8")
    assert read_csv(spark, str(tmp_path / "good.csv"), PAIRS, strict=True).count() == 1
    for columns in (["k", "name"], ["k"]):
        with pytest.raises(Exception, match="(?i)malformed"):
            read_csv(spark, str(tmp_path / "a.csv"), PAIRS, strict=True).select(*columns).collect()
    assert read_csv(spark, str(tmp_path / "a.csv"), PAIRS).count() == 6


def test_written_csv_is_plain(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', 1)], "name string, n int")
    assert write_csv(df.coalesce(1), str(tmp_path / "c"), mark=True) == 1
    (file,) = (tmp_path / "c").glob("part-*")
    assert file.read_bytes() == '\ufeffname,n\n"a ""b"", c",1\n'.encode()


def test_written_tables_can_be_removed(spark):
    shared.remove_written(spark)
    df = shared.written(spark.range(5), "gone")
    assert df.count() == 5
    assert shared.remove_written(spark) == 1 and shared.remove_written(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|No such file"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_written_rows_are_counted(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).withColumn("v", F.lit("药"))
    assert write_table(df, str(tmp_path / "p")) == 1000
    assert read_table(spark, str(tmp_path / "p")).count() == 1000
    assert write_csv(df, str(tmp_path / "c")) == 1000
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    assert read_csv(spark, str(tmp_path / "c"), schema).agg(F.sum("id")).first()[0] == 499500
    assert write_table(df, str(tmp_path / "q"), partition_by=["v"]) == 1000


def test_sql_with_arguments(spark):
    df = spark.range(10)
    assert query(spark, "SELECT id FROM {t} WHERE id > :low", {"low": 7}, t=df).count() == 2
    assert first_row(df, F.desc("id")).first()[0] == 9
    with pytest.raises(ValueError):
        first_row(df)


def test_jdbc_options():
    options = jdbc_options("jdbc:x", table="t", user="u", password="p", partition=("id", 0, 99, 4), push_filters=False)
    assert options["dbtable"] == "t" and options["numPartitions"] == "4" and options["upperBound"] == "99"
    assert options["preferTimestampNTZ"] == "true" and options["pushDownPredicate"] == "false"
    assert jdbc_options("jdbc:x", sql="select 1")["query"] == "select 1"
    for wrong in ({}, {"table": "t", "sql": "s"}, {"sql": "s", "partition": ("id", 0, 1, 2)}):
        with pytest.raises(ValueError):
            jdbc_options("jdbc:x", **wrong)


def test_shared_folder_comes_from_the_session(spark):
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.createDataFrame([("1", 2), ("x", None)], "k string, v int")
    copy = shared.written(df, "copy", partition_by=["k"])
    assert sorted(map(str, copy.select("k", "v").collect())) == sorted(map(str, df.collect()))
    assert shared.written(df.limit(0), "none", partition_by=["k"]).count() == 0


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1000]", "yarn"])
def test_no_local_folder_on_a_cluster(spark, master):
    def session(folder):
        class Context:
            _jvm, _jsc = spark.sparkContext._jvm, spark.sparkContext._jsc

            def getCheckpointDir(self):
                return None

        class Session:
            sparkContext = Context()

            class conf:
                get = staticmethod(lambda key, default=None: folder)

        Context.master = master
        return Session()

    for folder in (None, "/tmp/x"):
        with pytest.raises(ValueError):
            shared.shared_folder(session(folder))
    # a scheme says that the folder is mounted everywhere
    for folder in ("file:///mnt/x", "hdfs://host/x"):
        assert shared.shared_folder(session(folder)) == folder


@pytest.mark.parametrize("written", [4, 3, 0])
def test_resolved_folder_on_a_cluster_is_tried(spark, tmp_path, written):
    """Spark resolves a plain path; it is taken if what tasks write there is found again, and refused otherwise."""
    tries = []

    class Context:
        _jvm, _jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        master, defaultParallelism, applicationId = "local-cluster[2,2,1000]", 4, f"application-{tmp_path}"

        def getCheckpointDir(self):
            return f"file:{tmp_path}"

    class Session:
        sparkContext, read = Context(), spark.read

        class conf:
            get = staticmethod(lambda key, default=None: str(tmp_path))

        def range(self, *args):
            tries.append(args)
            return spark.range(0, written, 1, 4)

    for _ in range(2):
        if written == 4:
            assert shared.shared_folder(Session()) == f"file:{tmp_path}"
        else:
            with pytest.raises(ValueError):
                shared.shared_folder(Session())
    assert tries == [(0, 4, 1, 4)] and not list(tmp_path.iterdir())
